"""MinHash near-dedup: HyperMinHash.

A document is its set of word shingles. Words are hashed by xxh3, shingles by mixing the hashes of their words to
64 bits. A sketch has 128 registers, whatever the set's size; a register holds,
of the least hash that falls to it, the count of leading zeros and ten mantissa bits. For banding alone an
empty register borrows from the first filled one in a fixed random order of its own, so that borrowed places agree
as often as sets do. Bands of five registers make candidates; an estimate of the
Jaccard similarity, corrected for chance collisions, discards those far below the threshold; the rest is
verified on full sets of the words themselves, with integers.

1. One pass makes sketches. Documents with equal sets collapse to the one with the least id. Sets so small that no
   other set can reach the threshold have no bands.
2. Members of a band bucket that is shared meet as sketches. The task ties those whose estimate is not
   far below the threshold (union-find: a forest, not all pairs). The components of these ties hold every
   pair that can be similar.
3. Only members of components of two or more carry their texts on. A task verifies inside one component:
   band buckets again, least member first, then only pairs that aren't connected yet.
4. Verified ties, a forest from each task, and the ties of equal sets give the final components.

A bucket or component beyond `largest` members (or `heaviest` shingles) is split into chunks that each meet its least member;
only the members that aren't tied to that one are held against all chunks. So no task grows with a group, no pair of copies becomes
a row, and a group of near copies costs its size, not its square.

At the threshold t a pair of large sets shares no band with probability (1 - t^5)^25: 4e-7 at 0.85, 5e-5 at 0.8; a test
measures it for sets of all sizes. The filled registers of two sets are a sample of their union without replacement;
the estimate discards a pair only if it lies six standard deviations of such a sample below the threshold.

Defined results. Null, empty or wordless text: no shingles, linked with nothing, kept. Fewer words than a
shingle: all words are one. Ids are integers. Rows that share an id are one node. A null id: linked with nothing, component
null, kept. A very long text is one set in one task. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm.columns import sieve, text_tag
from braidwork.llm.components import components
from braidwork.llm.grouped import released, runs
from braidwork.llm.scratch import Scratch, small_batches

REGISTERS, MANTISSA, BAND = 128, 10, 5
BANDS = REGISTERS // BAND
LARGEST, HEAVIEST = 3000, 3_000_000
_TOP = 64 - REGISTERS.bit_length() + 1  # bits below those that choose a register
_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0xD6E8FEB86659FD93)


#: Hashes of words that a Python worker keeps: some 10 MB.
MOST_WORDS = 1 << 16


class _Hashes(dict):
    """64-bit hashes of words; emptied when it has grown to MOST_WORDS, as workers live on and their memory counts."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word, 20240521)
        return found


_hash_of = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """The words, A-Z in lower case; bytes know just the six ASCII white-space characters and ASCII letters."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], k: int) -> np.ndarray:
    """The set of k-word shingles, as sorted 64-bit hashes."""
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_hash_of.__getitem__, words), np.uint64, len(words))
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = _mix(out * _C + hashes[i : i + n])
    return np.unique(out)


def full_sets(documents: list[list[bytes]], k: int) -> list[np.ndarray]:
    """The sets of shingles of several documents, as sorted numbers that are equal where the words are: no hashing."""
    numbers: dict[bytes, int] = {}
    short: dict[tuple[bytes, ...], int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for words in documents for w in words), np.int64)
    windows, size = ids, max(1, len(numbers))
    spread = size
    for i in range(1, k):
        if spread > (1 << 62) // size:
            spread = len(ranks := np.unique(windows))
            windows = np.searchsorted(ranks, windows)
        windows = windows[:-1] * size + ids[i:] if len(windows) else windows
        spread *= size
    out, at = [], 0
    for words in documents:
        if 0 < len(words) < k:
            out.append(np.array([-1 - short.setdefault(tuple(words), len(short))]))
        else:
            out.append(np.unique(windows[at : at + max(0, len(words) - k + 1)]))
        at += len(words)
    return out


def _compress(low: np.ndarray, width: int) -> np.ndarray:
    """Leading zeros among `width` bits, from one up (zero is an empty register), and the bits after the leading one."""
    bits = np.frexp(low.astype(np.float64))[1]  # length in bits; where rounding adds one, it does so for equal values alike
    shift = bits - 1 - MANTISSA
    scaled = np.where(shift >= 0, low >> np.maximum(shift, 0).astype(np.uint64), low << np.maximum(-shift, 0).astype(np.uint64))
    zeros = np.clip(width - bits + 1, 1, 63)
    return (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | (scaled & np.uint64((1 << MANTISSA) - 1)).astype(np.uint16)


def registers(hashes: np.ndarray) -> np.ndarray:
    """Registers of a set whose hashes are parted by their top bits; 0 where none fell."""
    bounds = np.array(np.arange(REGISTERS, dtype=object) << _TOP, np.uint64)
    at = np.searchsorted(hashes, bounds)
    filled = np.append(at[1:], len(hashes)) > at
    out = np.zeros(REGISTERS, np.uint16)
    out[filled] = _compress(hashes[at[filled]] & np.uint64((1 << _TOP) - 1), _TOP)
    return out


@cache
def _donors() -> np.ndarray:
    """For each register the order in which others are asked: itself, then all in a random order."""
    rng = np.random.Generator(np.random.PCG64(77))
    orders = rng.permuted(np.tile(np.arange(REGISTERS), (REGISTERS, 1)), axis=1)
    own = orders == np.arange(REGISTERS)[:, None]
    return np.concatenate([np.arange(REGISTERS)[:, None], orders[~own].reshape(REGISTERS, -1)], axis=1)


def dense(held: np.ndarray) -> np.ndarray:
    """Registers with empty ones filled by their donors; a value bears its donor's number."""
    orders = _donors()
    donor = orders[np.arange(REGISTERS), (held > 0)[orders].argmax(1)]
    return held[donor].astype(np.uint32) | (donor.astype(np.uint32) << np.uint32(16))


def linkable(n: int, percent: int) -> bool:
    """Whether a set of n can reach the threshold with a set that isn't equal: the next larger or smaller one."""
    return n > 0 and 100 * n >= percent * (n + 1)


def band_keys(held: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, different bands apart."""
    parts = dense(held)[: BANDS * BAND].reshape(BANDS, BAND).astype(np.uint64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(BAND):
        out = _mix(out * _C + parts[:, i])
    return out.view(np.int64)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Registers expected to agree by chance between disjoint sets of n and m, many elements each."""
    ratio = np.maximum(n, m) / np.minimum(n, m)
    return 0.169919487159739 * 2.0 ** (REGISTERS.bit_length() - 1 - MANTISSA) * 4 * ratio / (1 + ratio) ** 2


def estimate(one: np.ndarray, n: int, others: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corrected Jaccard estimates of one sketch with others, and the registers each rests on."""
    own = one > 0
    used = (own | (others > 0)).sum(1)
    same = ((others == one) & own).sum(1)
    by_chance = chance(np.full(len(sizes), n), sizes)
    return np.maximum(0, same - by_chance) / np.maximum(1, used - by_chance), used


def plausible(one: np.ndarray, n: int, others: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which others may reach the threshold, by size and estimate, and the estimates.

    At the threshold two sets have a union of (n + m) / (1 + t), of which `used` registers show one element each.
    """
    t = percent / 100
    guess, used = estimate(one, n, others, sizes)
    union = (n + sizes) / (1 + t)
    unseen = np.clip((union - used) / np.maximum(1, union - 1), 0, 1)
    margin = 6 * np.sqrt(t * (1 - t) / np.maximum(1, used) * unseen) + 1.5 / np.maximum(1, used)
    return (guess >= t - margin) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)), guess


class Forest:
    """Union-find over 0..n-1 that keeps the ties which joined two trees."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.ties: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def tie(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.ties.append((i, j))


def tie_bucket(forest: Forest, bucket: np.ndarray, held: np.ndarray, sizes: np.ndarray, percent: int, test, probes: np.ndarray | None = None) -> None:
    """Tie all members of a bucket that are plausible and pass `test`, unless they are connected already.

    First everyone with the first member; then those outside the largest tree with all others, likeliest first. With
    `probes`, a mask over all members, only these are held against the others.
    """
    if probes is None:
        lead = int(bucket[0])
        near, _ = plausible(held[lead], sizes[lead], held[bucket], sizes[bucket], percent)
        for j in bucket[near].tolist():
            if forest.find(j) != forest.find(lead) and test(lead, j):
                forest.tie(lead, j)
        roots = np.array([forest.find(j) for j in bucket.tolist()])
        values, counts = np.unique(roots, return_counts=True)
        if len(values) < 2:
            return
        probing = bucket[roots != values[counts.argmax()]]
    else:
        probing = bucket[probes[bucket]]
    for i in probing.tolist():
        near, guess = plausible(held[i], sizes[i], held[bucket], sizes[bucket], percent)
        order = np.flatnonzero(near)
        for j in bucket[order[np.argsort(-guess[order], kind="stable")]].tolist():
            if forest.find(i) != forest.find(j) and test(i, j):
                forest.tie(i, j)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 |a & b| >= percent * |a | b|, on full sets."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def linked(documents: list[list[bytes]], k: int, percent: int, probes: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among documents (those of `probes` with any), by index, under the banding of the sketches."""
    sets = full_sets(documents, k)
    sizes = np.array([len(s) for s in sets])
    forest, tested = Forest(len(sets)), set()

    def test(i: int, j: int) -> bool:
        pair = (i, j) if i < j else (j, i)
        if pair in tested:
            return False
        tested.add(pair)
        return similar(sets[i], sets[j], percent)

    held = np.array([registers(shingles(words, k)) for words in documents])
    keys = np.array([band_keys(x) for x in held])
    for band in range(BANDS):
        by = np.argsort(keys[:, band], kind="stable")
        ordered = keys[by, band]
        cuts = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [len(by)]))
        for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            if b - a > 1:
                tie_bucket(forest, by[a:b], held, sizes, percent, test, probes)
    return forest.ties


def _sketches(docs: DataFrame, k: int, percent: int) -> DataFrame:
    kind = dict(docs.dtypes)["_id"]

    @released
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, marks, held, keys = [], [], [], []
            for text in batch.column(2):
                s = shingles(words_of(text.as_py()), k)
                n.append(len(s))
                marks.append(xxhash.xxh3_128_digest(s.tobytes()))
                own = registers(s) if linkable(len(s), percent) else None
                held.append(None if own is None else own.tobytes())
                keys.append(np.zeros(0, np.int64) if own is None else band_keys(own))
            halves = np.frombuffer(b"".join(marks), "<i8").reshape(-1, 2)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in keys]))), pa.int32()), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])))
            cols = [pa.array(n, pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(held, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["_id", "_tag", "n", "f1", "f2", "regs", "bands"])

    return docs.mapInArrow(made, f"_id {kind}, _tag long, n long, f1 long, f2 long, regs binary, bands array<long>")


def _groups(table: pa.Table, n_keys: int) -> Iterator[tuple[int, int]]:
    """Bounds of the groups of equal first columns."""
    new = np.zeros(table.num_rows, bool)
    for c in range(n_keys):
        k = table.column(c).to_numpy()
        new[1:] |= k[1:] != k[:-1]
    cuts = [0, *np.flatnonzero(new).tolist(), table.num_rows]
    return zip(cuts, cuts[1:], strict=False)


def _answers(table: pa.Table, judge) -> Iterator[pa.RecordBatch]:
    """(key, a, b) of tasks: rows (key, i, j, node, probe, ...) in order of the first three.

    `judge(rows, lead, probes)` gives ties by position among `rows`, positions in the table in order of node. j = -1 marks a
    task of one chunk and its group's leader, the only probe: members that it isn't tied to come back with b null. In other
    tasks the probes are held against all, or all against all where every row is one.
    """
    names, nodes, probe = table.column(0).to_numpy(), table.column("node").to_numpy(), table.column("probe").to_numpy(zero_copy_only=False)
    led = table.column(2).to_numpy() < 0
    keys, out = [], []
    for a, b in _groups(table, 3):
        by = a + np.lexsort((~probe[a:b], nodes[a:b]))
        by = by[np.append(True, nodes[by][1:] != nodes[by][:-1])]  # a probe may also be among the others
        if len(by) < 2:
            continue
        lead = int(np.flatnonzero(probe[by])[0]) if led[a] else None
        ties = judge(by, lead, None if probe[by].all() else probe[by])
        found = [(int(nodes[by[x]]), int(nodes[by[y]])) for x, y in ties]
        if lead is not None:
            tied = {lead, *(y for _, y in ties)}
            found += [(int(nodes[by[x]]), None) for x in range(len(by)) if x not in tied]
        keys += [names[a]] * len(found)
        out += found
    if out:
        x, y = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["key", "a", "b"])


@released
def _tie_sketches(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Ties worth verifying among rows (key, i, j, node, probe, n, regs)."""
    for table in runs(batches, 3, 1 << 20):
        every = table.column("n").to_numpy()
        sketches = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)

        def judge(rows: np.ndarray, lead: int | None, probes: np.ndarray | None) -> list[tuple[int, int]]:
            held, sizes = sketches[rows], every[rows]  # noqa: B023
            if lead is not None:
                near, _ = plausible(held[lead], sizes[lead], held, sizes, percent)
                return [(lead, x) for x in np.flatnonzero(near).tolist() if x != lead]
            forest = Forest(len(rows))
            tie_bucket(forest, np.arange(len(rows)), held, sizes, percent, lambda i, j: True, probes)
            return forest.ties

        yield from _answers(table, judge)


@released
def _verify(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Verified ties among rows (key, i, j, node, probe, _text)."""
    for table in runs(batches, 3, 1 << 20):
        texts = table.column("_text")

        def judge(rows: np.ndarray, lead: int | None, probes: np.ndarray | None) -> list[tuple[int, int]]:
            documents = [words_of(texts[int(x)].as_py()) for x in rows]  # noqa: B023
            if lead is None:
                return linked(documents, k, percent, probes)
            sets = full_sets(documents, k)
            return [(lead, x) for x in range(len(rows)) if x != lead and similar(sets[lead], sets[x], percent)]

        yield from _answers(table, judge)


def _tied(scratch: Scratch, rows: DataFrame, chunks: Column, fetch: Callable[[DataFrame], DataFrame], work, largest: int) -> DataFrame:
    """(a, b): ties among the nodes of each key; `rows` has key, node, _t, a row for each node of a key.

    A group of one chunk is one task. Of a larger one, each chunk meets the group's leader, its least node; only the
    nodes that the leader isn't tied to are then held against all chunks, so that a large group of near copies costs
    its size once. `fetch` joins what `work` needs to tasks (key, i, j, node, _t, probe).
    """
    sized = scratch.keep(rows.withColumn("_n", F.greatest(chunks, F.lit(1)).cast("int")).select("key", "node", "_t", "_n"))
    own = sized.withColumn("i", F.pmod(F.xxhash64("node"), F.col("_n")).cast("int"))
    leaders = sized.where("_n > 1").groupBy("key").agg(F.min(F.struct("node", "_t")).alias("_l"), F.max("_n").alias("_n"))
    spread = leaders.select("key", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("i"), F.lit(-1).alias("j"), "_l.node", "_l._t", F.lit(True).alias("probe"))
    many = F.col("_n") > 1
    tasks = own.select("key", "i", F.when(many, -1).otherwise(0).alias("j"), "node", "_t", (~many).alias("probe")).unionByName(spread)

    def done(t: DataFrame) -> DataFrame:
        met = fetch(t).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
        return scratch.keep(met.mapInArrow(work, "key long, a long, b long"))

    first = done(tasks)
    left = scratch.keep(first.where("b is null").select("key", F.col("a").alias("node")).distinct())
    ties = first.where("b is not null").select("a", "b")
    if left.head(1):
        half = max(1, largest // 2)
        groups = left.groupBy(F.col("key").alias("_k")).agg(F.ceil(F.count("*") / half).cast("int").alias("_r"))
        met = sized.join(groups, F.col("key") == F.col("_k")).drop("_k").withColumn("_n", F.col("_n") * 2)
        probes = met.join(left, ["key", "node"]).withColumn("i", F.pmod(F.xxhash64("node", F.lit(1)), F.col("_r")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        others = met.withColumn("j", F.pmod(F.xxhash64("node"), F.col("_n")).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("_r") - 1)))
        side = lambda t, probe: t.select("key", "i", "j", "node", "_t", F.lit(probe).alias("probe"))
        ties = ties.unionByName(done(side(probes, True).unionByName(side(others, False))).select("a", "b"))
    return ties


def near_duplicates(
    spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", largest: int = LARGEST, heaviest: int = HEAVIEST
) -> DataFrame:
    """One row per document: text_tag, n_shingles, component_id (least id reachable) and kept."""
    small_batches(spark)
    scratch = Scratch(spark, "minhash")
    own = docs.select(F.col(id_col).cast("long").alias("_id"), text_tag(text_col).alias("_tag"), F.col(text_col).alias("_text"))
    sketched = scratch.keep(_sketches(own, k, percent))
    able = sketched.where("n > 0 and _id is not null")
    reps = scratch.keep(able.groupBy("f1", "f2").agg(F.min("_id").alias("rep")))
    copies = able.join(reps, ["f1", "f2"]).where("_id <> rep").select(F.col("_id").alias("a"), F.col("rep").alias("b"))
    unique = able.join(reps, (able["_id"] == reps["rep"]) & (able["f1"] == reps["f1"]) & (able["f2"] == reps["f2"])).select("_id", "_tag", "n", "regs", "bands")
    unique = scratch.keep(unique.dropDuplicates(["_id", "_tag"]))

    keys = unique.select("_id", "_tag", F.explode("bands").alias("key"))
    shared = scratch.keep(keys.groupBy("key").agg(F.count("*").alias("_m")).where("_m > 1"))
    routes = keys.join(shared.hint("merge"), "key").select("key", "_m", F.col("_id").alias("node"), F.col("_tag").alias("_t"))
    sketches = unique.select("_id", "_tag", "n", "regs").hint("merge")
    named = (F.col("node") == F.col("_id")) & (F.col("_t") == F.col("_tag"))
    ties = _tied(
        scratch, routes, F.ceil(F.col("_m") / largest), lambda t: t.join(sketches, named).select("key", "i", "j", "node", "probe", "n", "regs"),
        lambda it: _tie_sketches(it, percent), largest,
    )
    coarse = components(scratch, ties)
    members = scratch.keep(coarse.unionByName(coarse.select(F.col("root").alias("node"), "root").distinct()))
    weighed = scratch.keep(members.join(unique.select(F.col("_id").alias("node"), F.col("_tag").alias("_t"), "n"), "node"))
    sizes = weighed.groupBy("root").agg(F.count("*").alias("_m"), F.sum("n").alias("_w"))
    chunks = F.greatest(F.ceil(F.col("_m") / largest), F.ceil(F.col("_w") / heaviest))
    routed = weighed.join(sizes, "root").select(F.col("root").alias("key"), "_m", "_w", "node", "_t")
    # not a semi-join, which the optimizer would push below the sieve; a repeated row only repeats a member
    texts = sieve(own, "_id", weighed.select("node"))
    links = _tied(
        scratch, routed, chunks, lambda t: texts.join(t, named).select("key", "i", "j", "node", "probe", "_text"), lambda it: _verify(it, k, percent), largest,
    )
    final = components(scratch, links.unionByName(copies))
    for done in (reps, unique, shared, members, weighed):
        scratch.drop(done)
    joined = sketched.join(final, F.col("_id") == F.col("node"), "left")
    component = F.coalesce("root", "_id")
    return joined.select(F.col("_id").alias(id_col), F.col("_tag").alias("text_tag"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("_id"), F.lit(True)).alias("kept"))


def deduplicated(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one of each component left: that of the least id, and of its repeated rows one."""
    found = near_duplicates(spark, docs, k, percent, id_col, text_col).where(F.col("kept") & F.col(id_col).isNotNull())
    kept = found.select(F.col(id_col).alias("__bw_i"), F.col("text_tag").alias("__bw_t")).groupBy("__bw_i").agg(F.min("__bw_t").alias("__bw_t"))
    tagged = docs.withColumn("__bw_tag", text_tag(text_col))
    named = tagged.where(F.col(id_col).isNotNull()).dropDuplicates([id_col, "__bw_tag"])
    left = named.join(kept, (F.col(id_col) == F.col("__bw_i")) & (F.col("__bw_tag") == F.col("__bw_t"))).select(*docs.columns)
    return left.unionByName(tagged.where(F.col(id_col).isNull()).select(*docs.columns))
