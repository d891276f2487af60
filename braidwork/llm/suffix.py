"""Suffix-array dedup: every byte under a 400-byte string that also starts somewhere else.

Equal windows must meet in one task, but no task may see the corpus. Each window of `width` bytes
names a bucket by its minimizer, the least hash among its 16-byte strings. Equal windows have equal
minimizers, so buckets part the problem exactly. Neighbouring windows with one minimizer form a
segment of less than 2 * width bytes.

1. One pass over the texts lists segments as (minimizer, 128-bit content hash, place): numbers
   only. Minimizers seen once can't repeat; a minimizer with a single content that occurs twice
   repeats in full.
2. Of the rest each different content is fetched once and goes to its bucket, where a suffix array
   over the bucket's segments is built by two-stage sorting: only suffixes smaller than their
   successors are sorted directly, the others are induced by scans over the buckets of their first
   byte. Common prefixes of neighbours then tell which windows repeat.
3. A bucket with more than `limit` contents (a passage shared by a large part of all documents) is
   not gathered: its windows are counted by their 128-bit hashes, which is exact as well.
4. Repeated windows go back to all places of their content, and each document is cut on its own.

Defined results. Null text: as empty; nothing removed. A text shorter than `width` has no windows.
Repeated rows repeat each other. A null id is an id. A very long text is hashed in chunks and cut in one task. An empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm.columns import text_tag
from braidwork.llm.grouped import released, runs
from braidwork.llm.passages import WORDS, documents_with_passages
from braidwork.llm.scratch import Scratch, small_batches

WIDTH = 400
GRAM = 16
LIMIT = 4_000
#: Window starts that are hashed at a time; places inside take 16 bits.
CHUNK = 60_000
#: Text of whole buckets that one suffix array is built over, at least.
BATCH = 1 << 19

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)


def _words(data: np.ndarray) -> np.ndarray:
    """The 8-byte number that starts at each byte."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view("<u8").ravel()


def segments(data: bytes, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, minimizer) of each run of windows that share their leftmost minimizer."""
    total = len(data) - width + 1
    first, count, name = [], [], []
    whole = np.frombuffer(data, np.uint8)
    grams = width - GRAM + 1
    for base in range(0, total, CHUNK):
        part = whole[base : base + CHUNK + width - 1]
        eight = _words(part)
        m = len(part) - GRAM + 1
        h = eight[:m] * _M1 ^ eight[8 : 8 + m] * _M2
        h ^= h >> np.uint64(29)
        h *= _M3
        h ^= h >> np.uint64(32)
        low = (h & np.uint64(0xFFFFFFFFFFFF0000)) | np.arange(m, dtype=np.uint64)
        span = 1
        while span * 2 <= grams:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        n = m - grams + 1
        low = np.minimum(low[:n], low[grams - span : grams - span + n])
        starts = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1))
        first.append(starts + base)
        count.append(np.diff(starts, append=n))
        name.append((low[starts] >> np.uint64(16)).astype(np.int64))
    if not first:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(first), np.concatenate(count), np.concatenate(name)


def suffix_order(parts: list[bytes], starts: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Window starts in suffix order; `starts` are their places in the parts joined by one zero byte each.

    Suffixes are compared up to the end of their part, or to `width` bytes where sorted directly;
    every suffix that is a window ends up in order by its first `width` bytes at least.
    """
    blob = b"\0".join(parts) + b"\0"
    n = len(blob)
    t = np.frombuffer(blob, np.uint8).astype(np.int16) + 1
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    t[ends] = 0  # less than any byte
    step = np.diff(t, append=1)
    step[-1] = 1
    place, last = np.arange(n, dtype=np.int32), np.int32(n - 1)
    settled = np.minimum.accumulate(np.where(step != 0, place, last)[::-1])[::-1]
    small = step[settled] > 0  # smaller than its successor; the ends count as such
    next_small = np.minimum.accumulate(np.where(small, place, last)[::-1])[::-1]
    wanted = np.zeros(n, bool)
    wanted[starts] = True
    # what a window's order is induced from: the suffixes up to the next one that is sorted directly
    lasts = starts[~small[starts] & ~wanted[np.minimum(starts + 1, n - 1)]]
    for a, b in zip(lasts.tolist(), next_small[lasts].tolist(), strict=True):
        wanted[a : b + 1] = True
    induced = wanted & ~small
    seeds = np.flatnonzero(wanted & small)
    pair = t[seeds].astype(np.int32) * 257 + t[np.minimum(seeds + 1, n - 1)]
    by_pair = np.argsort(pair, kind="stable")
    seeds, pair = seeds[by_pair], pair[by_pair]
    stops = np.minimum(seeds + width, ends[np.searchsorted(ends, seeds)])
    bounds = np.concatenate(([0], np.flatnonzero(pair[1:] != pair[:-1]) + 1, [len(seeds)])) if len(seeds) else np.zeros(1, int)
    for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
        if b - a > 1 and t[seeds[a]]:
            keys = [blob[i:j] for i, j in zip(seeds[a:b].tolist(), stops[a:b].tolist(), strict=True)]
            seeds[a:b] = seeds[a:b][sorted(range(b - a), key=keys.__getitem__)]
    heads = np.searchsorted(t[seeds], np.arange(258))
    arrived: list[list[np.ndarray]] = [[] for _ in range(257)]
    order = []
    for c in range(257):
        got = []
        wave = np.concatenate(arrived[c]) if arrived[c] else seeds[:0]
        while len(wave):
            got.append(wave)
            before = wave - 1
            wave = before[induced[before] & (t[before] == c)]
        got.append(seeds[heads[c] : heads[c + 1]])
        own = np.concatenate(got)
        if not len(own):
            continue
        order.append(own)
        before = own - 1
        before = before[induced[before] & (t[before] > c)]
        if len(before):
            char = t[before]
            by_char = np.argsort(char, kind="stable")
            before, char = before[by_char], char[by_char]
            cuts = np.concatenate(([0], np.flatnonzero(char[1:] != char[:-1]) + 1, [len(char)]))
            for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                arrived[char[a]].append(before[a:b])
    found = np.concatenate(order) if order else seeds[:0]
    is_start = np.zeros(n, bool)
    is_start[starts] = True
    return found[is_start[found]]


def common_prefixes(blob: bytes, order: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Length of the common prefix of neighbours in the order, `width` at most."""
    eight = _words(np.frombuffer(blob, np.uint8))
    a, b = order[:-1], order[1:]
    out = np.full(len(a), width, np.int64)
    alive = np.arange(len(a))
    for at in [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]:
        if not len(alive):
            break
        differ = eight[a[alive] + at] ^ eight[b[alive] + at]
        ended = differ != 0
        if ended.any():
            x = differ[ended]
            out[alive[ended]] = at + np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) // 8
            alive = alive[~ended]
    return out


def repeated(parts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """For each part, which of its windows occurs again in any part."""
    counts = np.array([max(0, len(p) - width + 1) for p in parts])
    offsets = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])))
    starts = np.concatenate([np.arange(o, o + c) for o, c in zip(offsets, counts, strict=False)]) if len(parts) else counts
    blob = b"\0".join(parts) + b"\0"
    hit = np.zeros(len(blob), bool)
    if len(starts) > 1:
        order = suffix_order(parts, starts, width)
        same = common_prefixes(blob, order, width) >= width
        hit[order[:-1][same]] = True
        hit[order[1:][same]] = True
    return [hit[o : o + c] for o, c in zip(offsets, counts, strict=False)]


def _ranges(mask: np.ndarray) -> list[int]:
    """Bounds of the runs of True, flat."""
    edge = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
    return edge.tolist()


def _list_segments(docs: DataFrame, width: int) -> DataFrame:
    kind = dict(docs.dtypes)["_id"]

    @released
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                rows, first, count, name, content = [], [], [], [], []
                for i, text in enumerate(some.column(2)):
                    data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                    a, n, m = segments(data, width)
                    rows.append(np.full(len(a), i))
                    first.append(a), count.append(n), name.append(m)
                    view = memoryview(data)
                    content += [xxhash.xxh3_128_digest(view[x:y]) for x, y in zip(a.tolist(), (a + n + width - 1).tolist(), strict=True)]
                take = pa.array(np.concatenate(rows))
                halves = np.frombuffer(b"".join(content), "<i8").reshape(-1, 2)
                cols = [np.concatenate(first), np.concatenate(count).astype(np.int32), np.concatenate(name), halves[:, 0].copy(), halves[:, 1].copy()]
                yield pa.RecordBatch.from_arrays([some.column(0).take(take), some.column(1).take(take), *map(pa.array, cols)], names=["_id", "_tag", "pos", "n", "mini", "c1", "c2"])

    return docs.mapInArrow(listed, f"_id {kind}, _tag long, pos long, n int, mini long, c1 long, c2 long")


@released
def _sort_buckets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows (mini, c1, c2, copies, part), whole buckets together, to the repeated windows of each part."""
    for table in runs(batches, 1, BATCH):
        parts = table.column("part").to_pylist()
        copies = table.column("copies").to_numpy()
        found = [[0, len(p) - width + 1] if c > 1 else _ranges(m) for p, c, m in zip(parts, copies, repeated(parts, width), strict=True)]
        keep = pa.array([bool(x) for x in found])
        out = table.select(["mini", "c1", "c2"]).append_column("ranges", pa.array(found, pa.list_(pa.int32()))).filter(keep)
        yield from out.combine_chunks().to_batches()


@released
def _hash_windows(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            part = batch.column(4)[i].as_py()
            view = memoryview(part)
            n = len(part) - width + 1
            halves = np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[k : k + width]) for k in range(n)), "<i8").reshape(-1, 2)
            same = [pa.array(np.full(n, batch.column(c)[i].as_py())) for c in range(4)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(n, dtype=np.int32)), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], names=["mini", "c1", "c2", "copies", "at", "w1", "w2"])


@released
def _cut(batches: Iterator[pa.RecordBatch], id_col: str, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans, passage in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            flat = spans.values.to_numpy() if spans.is_valid and len(spans.values) else np.zeros(0, np.int64)
            a, b = flat[::2], flat[1::2] + width - 1
            kept, removed, n_spans, at = hashlib.sha256(), 0, 0, 0
            if len(a):
                by = np.argsort(a, kind="stable")
                a, b = a[by], np.maximum.accumulate(b[by])
                new = np.concatenate(([True], a[1:] > b[:-1]))
                a, b = a[new], b[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(b) - 1]))]
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    kept.update(data[at:x])
                    removed, n_spans, at = removed + y - x, n_spans + 1, y
            kept.update(data[at:])
            rows.append((len(data), removed, n_spans, kept.hexdigest(), n_spans > 0, passage.as_py()))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "has_repeats", "has_passage"])


def repeated_spans(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, limit: int = LIMIT) -> DataFrame:
    """(_id, _tag, spans): for each document with repeated windows, bounds a, b of runs of window starts, flat."""
    small_batches(spark)
    scratch = Scratch(spark, "suffix")
    own = docs.select(F.col(id_col).alias("_id"), text_tag(text_col).alias("_tag"), F.col(text_col).alias("_text"))
    listed = scratch.keep(_list_segments(own, width))
    content, whole = ["c1", "c2"], ["mini", "c1", "c2"]
    minis = listed.groupBy("mini").agg(
        F.count("*").alias("_m"), F.min("c1").alias("_a1"), F.max("c1").alias("_b1"), F.min("c2").alias("_a2"), F.max("c2").alias("_b2")
    ).where("_m > 1").select("mini", ((F.col("_a1") != F.col("_b1")) | (F.col("_a2") != F.col("_b2"))).alias("several"))
    # written first: a join of two plain exchanges is one whose large partitions can be split
    places = scratch.keep(listed.join(scratch.keep(minis), "mini"))
    scratch.drop(listed)

    contents = places.where("several").groupBy(*whole).agg(F.count("*").alias("copies"), F.min_by(F.struct("_id", "_tag", "pos", "n"), F.struct("_id", "_tag", "pos")).alias("_at"))
    wanted = contents.select(F.col("_at._id").alias("_i"), F.col("_at._tag").alias("_t"), F.struct(*whole, "copies", "_at.pos", "_at.n").alias("_s"))
    by_doc = wanted.groupBy("_i", "_t").agg(F.collect_list("_s").alias("_s"))
    raw = F.encode("_text", "utf-8")
    texts = own.select("_id", "_tag", raw.alias("_raw")).where(F.octet_length("_raw") >= width)
    met = texts.join(by_doc, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_tag") == F.col("_t")))
    cut = F.transform("_s", lambda s: F.struct(s["mini"].alias("mini"), s["c1"].alias("c1"), s["c2"].alias("c2"), s["copies"].alias("copies"), F.substring(F.col("_raw"), s["pos"].cast("int") + 1, s["n"] + width - 1).alias("part")))
    parts = scratch.keep(met.select(cut.alias("_s")).select(F.explode("_s").alias("_s")).select("_s.*"))
    hot = scratch.keep(parts.groupBy("mini").count().where(F.col("count") > limit).select("mini"))

    dealt = parts.join(hot, "mini", "left_anti").repartition("mini").sortWithinPartitions("mini")
    sorted_ = dealt.mapInArrow(lambda it: _sort_buckets(it, width), "mini long, c1 long, c2 long, ranges array<int>")
    windows = parts.join(hot, "mini", "left_semi").repartition(*content).mapInArrow(lambda it: _hash_windows(it, width), "mini long, c1 long, c2 long, copies long, at int, w1 long, w2 long")
    twice = windows.groupBy("w1", "w2").agg(F.sum("copies").alias("_n")).where("_n > 1").drop("_n")
    # one row per window that repeats; a content's windows are fewer than `width`
    counted = windows.join(twice, ["w1", "w2"]).groupBy(*whole).agg(F.collect_set("at").alias("_at")).select(*whole, F.flatten(F.transform("_at", lambda x: F.array(x, x + 1))).alias("ranges"))
    found = scratch.keep(sorted_.unionByName(counted))
    scratch.drop(parts)

    at_all = places.where("several").join(found, whole).select("_id", "_tag", F.transform("ranges", lambda x: x + F.col("pos")).alias("_r"))
    in_full = places.where("not several").select("_id", "_tag", F.array(F.col("pos"), F.col("pos") + F.col("n")).alias("_r"))
    return at_all.unionByName(in_full).groupBy("_id", "_tag").agg(F.flatten(F.collect_list("_r")).alias("spans"))


def suffix_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, limit: int = LIMIT, words: int = WORDS) -> DataFrame:
    """One row per document: its bytes, those removed, the number of removed runs, the digest of the rest, whether anything
    goes, and whether it holds a passage of `words` words that stands in another document too (of any length in bytes)."""
    spans = repeated_spans(spark, docs, id_col, text_col, width, limit)
    own = docs.select(F.col(id_col).alias("_id"), text_tag(text_col).alias("_tag"), F.col(text_col).alias("_text"))
    shared = documents_with_passages(Scratch(spark, "passages"), own, words)
    marked = own.select("_id", "_tag").join(shared, "_tag").select("_id", "_tag", F.lit(True).alias("_p"))
    both = spans.withColumn("_p", F.lit(False)).unionByName(marked, allowMissingColumns=True).groupBy(F.col("_id").alias("_i"), F.col("_tag").alias("_t"))
    known = both.agg(F.max_by("spans", F.col("spans").isNotNull()).alias("spans"), F.max("_p").alias("_p"))
    met = own.join(known, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_tag") == F.col("_t")), "left").select("_id", "_text", "spans", F.coalesce("_p", F.lit(False)).alias("_p"))
    kind = dict(docs.dtypes)[id_col]
    return met.mapInArrow(lambda it: _cut(it, id_col, width), f"{id_col} {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, has_repeats boolean, has_passage boolean")
