"""Arrow-batched UDFs over the rules of indic.py; only where a column expression can't do it."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from braidwork.functions import indic


def _text(rule, kind=T.StringType()):
    @F.pandas_udf(kind)
    def apply(text: pd.Series) -> pd.Series:
        return text.map(rule)

    return apply


def _pair(rule, kind=T.DoubleType()):
    @F.pandas_udf(kind)
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([rule(x, y) for x, y in zip(a, b, strict=True)])

    return apply


romanise = _text(indic.romanise)
compare_space = _text(indic.compare_space)
clean = _text(indic.clean)
repair = _text(indic.repair)
spell_numbers = _text(indic.spell_numbers)
devanagari = _text(indic.devanagari)
clauses = _text(indic.clauses, T.ArrayType(T.StringType()))
sentences = _text(indic.sentences, T.ArrayType(T.StringType()))
cer = _pair(indic.cer)
cer_spaced = _pair(indic.cer_spaced)
wer = _pair(indic.wer)
similarity = _pair(indic.similarity)
distance = _pair(indic.distance, T.LongType())


def similar(least: float):
    """Whether the similarity of two texts is at least so much."""
    return _pair(lambda a, b: indic.similar(a, b, least), T.BooleanType())


def seeds(base: int):
    """A 31-bit seed of a key."""
    return _text(lambda key: indic.fnv_seed(base, key), T.LongType())


def english_recall(stop: list[str]):
    """Recall of a text's English words in another text."""
    words = frozenset(stop)
    return _pair(lambda a, b: indic.english_recall(a, b, words))


def token_chunks(most: int):
    return _text(lambda t: indic.token_chunks(t, most), T.ArrayType(T.StringType()))


@F.pandas_udf(T.DoubleType())
def recall(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series([indic.recall(a, b) for a, b in zip(ref, hyp, strict=True)])


SCORES = ["recall", "cer", "wer", "cer_spaced"]


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in SCORES]))
def pair_scores(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([indic.pair_scores(a, b) for a, b in zip(ref, hyp, strict=True)], columns=SCORES, dtype=float)


@F.pandas_udf(T.DoubleType())
def recall_tagged(ref: pd.Series, hyp: pd.Series, tags: pd.Series) -> pd.Series:
    return pd.Series([indic.recall(a, b, None if t is None else list(t)) for a, b, t in zip(ref, hyp, tags, strict=True)])


#: Fixed value: characters of text after which the normaliser hands its rows on.
PORTION = 1 << 18


def portions(texts: Iterable[pa.Array], most: int = PORTION) -> Iterator[list[str | None]]:
    """The rows of each batch in lists of up to `most` characters, or of one longer text."""
    for batch in texts:
        held, size = [], 0
        for value in batch:
            text = value.as_py()
            if held and size + len(text or "") > most:
                yield held
                held, size = [], 0
            held.append(text)
            size += len(text or "")
        if held:
            yield held


def mixed_normaliser(force: dict, names: dict, ambiguous: dict, english: set, lexicon: dict):
    """The two-pass normaliser with its dictionaries (bounded assets, sent once per task).

    A span per word takes many times the text, so a worker holds those of one portion at a time.
    """
    parts = ("src", "lang", "how")
    kind = T.StructType([T.StructField("out", T.StringType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in parts])))])

    @F.arrow_udf(kind)
    def apply(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        normalise = indic.mixed_normaliser(force, names, ambiguous, english, lexicon)
        for rows in portions(texts):
            done = [normalise(t) for t in rows]
            every = [x for _, spans in done for x in spans]
            span = pa.StructArray.from_arrays([pa.array([getattr(x, a) for x in every], pa.string()) for a in ("source", "language", "how")], list(parts))
            ends = pa.array([0, *itertools.accumulate(len(spans) for _, spans in done)], pa.int32())
            yield pa.StructArray.from_arrays([pa.array([out for out, _ in done], pa.string()), pa.ListArray.from_arrays(ends, span)], ["out", "spans"])

    return apply
