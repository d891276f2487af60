"""Braidwork: a PySpark-native engine for curating and evaluating code-mixed corpora."""

__version__ = "0.1.0"
