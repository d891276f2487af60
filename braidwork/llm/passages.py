"""Passages of many words that stand in more than one document, found by winnowing and confirmed window by window.

The byte windows of suffix.py measure a passage in bytes; a passage of 51 short words may have fewer than 400. Here a
window has `words` words, however they are separated.

1. One pass hashes words, and grams of g words, rolling. Of all grams of any `words` words the least is selected,
   so every passage of `words` words holds a selected gram, chosen from the passage alone. A selected gram is listed with
   a hash of itself and the words on either side that a window with it may reach (its content): numbers only, one for about twenty words.
2. A content in two documents is a common passage of `words` words or more. Where a shared gram has several contents and stands in a document
   that this leaves open, each different one is looked up once and gives the hashes of the windows around the gram; equal windows tie
   contents.

All groups are aggregations with partial sums, and a gram's rows are its occurrences, never pairs of them. Windows and
contents are compared by 64-bit hashes of words' hashes.

Defined results. Documents are told apart by a tag of their text: rows with equal texts of `words` words or more share their
passage. Null text or fewer words: none. A very long text is hashed in parts that overlap. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.grouped import released
from braidwork.llm.hyperminhash import _hash_of, _mix
from braidwork.llm.scratch import Scratch

WORDS, GRAM = 51, 12
#: Words hashed at a time; places inside take 20 bits.
PART = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_SIDE = np.uint64(0xD6E8FEB86659FD93)


class _Rolling:
    """Hashes of any run of words of a text, from one cumulated sum."""

    def __init__(self, words: list[bytes]):
        n = len(words)
        hashes = np.fromiter(map(_hash_of.__getitem__, words), np.uint64, n)
        up = np.full(n + 1, _BASE, np.uint64)
        down = np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        self._down = np.multiply.accumulate(down)
        self._sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * np.multiply.accumulate(up)[:n])))

    def runs(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self._sums[stop] - self._sums[start]) * self._down[start] + (stop - start).astype(np.uint64) * _SIDE)


def gram_words(width: int) -> int:
    """Words of a gram: few, as windows with many grams have fewer selected, but enough to be rare."""
    return min(GRAM, (width + 1) // 2)


def selected(grams: np.ndarray, g: int) -> np.ndarray:
    """Places of the least of any g neighbouring grams, the first among equals."""
    out = []
    for base in range(0, max(1, len(grams) - g + 1), PART):
        part = grams[base : base + PART + g - 1]
        low = (part & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(len(part), dtype=np.uint64)
        span = 1
        while span * 2 <= g:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        n = len(part) - g + 1
        low = np.minimum(low[:n], low[g - span : g - span + n])
        places = (low & np.uint64(0xFFFFF)).astype(np.int64) + base  # never descending
        out.append(places[np.append(True, places[1:] != places[:-1])])
    found = np.concatenate(out)
    return found[np.append(True, found[1:] != found[:-1])]


def listed_grams(words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, gram, content) of the selected grams of a text."""
    n, g = len(words), gram_words(width)
    if n < width:
        return (np.zeros(0, np.int64),) * 3
    rolling = _Rolling(words)
    starts = np.arange(n - g + 1)
    grams = rolling.runs(starts, starts + g)
    at = selected(grams, width - g + 1)
    left, right = np.maximum(at - (width - g), 0), np.minimum(at + width, n)
    content = _mix(rolling.runs(left, right) * _SIDE + (at - left).astype(np.uint64))
    return at, grams[at].view(np.int64), content.view(np.int64)


def windows_around(words: list[bytes], at: list[int], width: int) -> Iterator[np.ndarray]:
    """For each place the hashes of the windows that hold its gram."""
    n, g = len(words), gram_words(width)
    rolling = _Rolling(words)
    for a in at:
        starts = np.arange(max(0, a - (width - g)), min(a, n - width) + 1)
        yield rolling.runs(starts, starts + width).view(np.int64)


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def documents_with_passages(scratch: Scratch, own: DataFrame, words: int = WORDS) -> DataFrame:
    """(_tag): tags of the texts that share a passage; `own` has _id, _tag, _text."""

    @released
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base in range(0, batch.num_rows, 256):
                part = batch.slice(base, 256)
                found = [listed_grams(_split(x.as_py()), words) for x in part.column(1)]
                which = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
                cols = [np.concatenate([x[i] for x in found]) for i in range(3)]
                lead = np.append(True, which[1:] != which[:-1])[: len(which)]  # a row for each document
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(which)), pa.array(cols[0].astype(np.int32)), pa.array(cols[1]), pa.array(cols[2]), pa.array(lead)], names=["_tag", "at", "gram", "content", "lead"])

    grams = scratch.keep(own.select("_tag", "_text").mapInArrow(listed, "_tag long, at int, gram long, content long, lead boolean"))
    several = lambda c: F.min(c) != F.max(c)
    # small tables are written before they are joined: a join of two plain exchanges is one whose large partitions can be split
    twice = scratch.keep(grams.groupBy("gram").agg(F.count("*").alias("_n")).where("_n > 1").select("gram"))
    again = scratch.keep(grams.drop("lead").join(twice, "gram"))
    copied = scratch.keep(grams.where("lead").groupBy("_tag").agg(F.count("*").alias("_n")).where("_n > 1").select("_tag"))
    scratch.drop(grams)
    shared = again.groupBy("gram").agg(several("_tag").alias("_many"), several("content").alias("_unlike")).where("_many").select("gram", "_unlike")
    met = scratch.keep(again.join(scratch.keep(shared), "gram"))
    contents = scratch.keep(met.groupBy("gram", "content").agg(several("_tag").alias("_many"), F.max("_unlike").alias("_unlike"), F.min(F.struct("_tag", "at")).alias("_first")))

    # what a content in two documents settles; windows are looked up only for grams of documents that are still open
    sure = scratch.keep(met.join(contents.where("_many").select("gram", "content"), ["gram", "content"]).select("_tag").distinct())
    open_ = scratch.keep(met.where("_unlike").join(sure, "_tag", "left_anti").select("gram").distinct())
    wanted = contents.join(open_, "gram").groupBy(F.col("_first._tag").alias("_t")).agg(F.collect_set("_first.at").alias("_all"))
    one = own.groupBy("_tag").agg(F.min("_id").alias("_i"))
    places = wanted.join(one, F.col("_t") == F.col("_tag")).select("_t", "_i", "_all")
    texts = own.join(places, (F.col("_tag") == F.col("_t")) & F.col("_id").eqNullSafe(F.col("_i"))).select("_tag", "_text", "_all")

    @released
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tag, text, places in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                flat = np.unique(np.concatenate(list(windows_around(_split(text.as_py()), places.as_py(), words))))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), tag.as_py())), pa.array(flat)], names=["_tag", "window"])

    # a content of one text needs no name here: its windows tie the text itself
    around = scratch.keep(texts.mapInArrow(windows, "_tag long, window long"))
    tied = scratch.keep(around.groupBy("window").agg(several("_tag").alias("_many")).where("_many").select("window"))
    found = around.join(tied, "window").select("_tag")
    return found.unionByName(sure).unionByName(copied).distinct()
