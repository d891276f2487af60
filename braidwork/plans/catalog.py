"""Registered queries and their SQL twins. A query's name starts with its place in the survey's inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Register a function under its name, with its SQL twin."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if oracle is not None:
            ORACLES[name or f.__name__] = oracle
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Floating columns rounded, so that the order of a sum doesn't show."""
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


# the families fill the tables above
from braidwork.plans import aggregate_queries, join_queries, report_queries, selection_queries, text_queries  # noqa: E402, F401
