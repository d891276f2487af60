"""Greedy near-duplicate removal: an earlier kept text suppresses later ones whose signatures agree enough.

Signatures of `perms` minima agree in t * perms slots only if, cut in perms - ceil(t * perms) + 1 bands, one band is
equal throughout. Joining on bands therefore loses no pair. Who is kept follows in rounds: a text without an earlier
open neighbour is kept, its later neighbours are dropped; each round settles at least the first of every open
component, and nothing but edges and states is written between rounds.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.functions import columns as C
from braidwork.operators.ranking import written


#: Shingles that are looked up at once, characters in a word of a key, bits of a character, a factor that mixes bits.
AT_ONCE, PACKED, CHAR, MIX = 1 << 12, 3, 21, np.uint64(0x9E3779B97F4A7C15)


class Minima:
    """Salted 64-bit BLAKE2b of shingles, remembered in a table of fixed size; a full table keeps the half that was used most.

    Shingles are looked up by their characters, packed into words, those of several texts together: a hash table with linear
    probing over arrays. The first 16 bits of all hashes of a text say which few are read in full.
    """

    def __init__(self, perms: int, most: int = 1 << 18):
        self.salted = [hashlib.blake2b(digest_size=8, salt=p.to_bytes(2, "little")) for p in range(perms)]
        self.rows = np.empty((most, perms), "<u8")
        self.tops = np.empty((most, perms), np.uint16)
        self.bits = (4 * most - 1).bit_length()
        self._start(0)

    def _start(self, words: int) -> None:
        self.keys = np.zeros((words, len(self.rows)), np.uint64)
        self.used = np.zeros(len(self.rows), np.int64)
        self.index = np.full(1 << self.bits, -1, np.int32)
        self.n = 0

    def hashes(self, shingle: bytes) -> np.ndarray:
        found = []
        for start in self.salted:
            h = start.copy()
            h.update(shingle)
            found.append(h.digest())
        return np.frombuffer(b"".join(found), "<u8")

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        h = keys[0] * MIX
        for word in keys[1:]:
            h = (h ^ h >> np.uint64(32) ^ word) * MIX
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for those that aren't there."""
        slots = self._slots(keys)
        found = self.index[slots]
        other = np.flatnonzero((found >= 0) & (self.keys[:, found] != keys).any(0))
        while len(other):
            slots[other] = slots[other] + 1 & len(self.index) - 1
            found[other] = at = self.index[slots[other]]
            other = other[(at >= 0) & (self.keys[:, at] != keys[:, other]).any(0)]
        return found

    def _enter(self, places: np.ndarray) -> None:
        slots = self._slots(self.keys[:, places])
        while len(places):
            free = self.index[slots] < 0
            self.index[slots[free]] = places[free]  # one of those that meet
            left = self.index[slots] != places
            slots, places = slots[left] + 1 & len(self.index) - 1, places[left]

    def _make_room(self) -> None:
        half = len(self.rows) // 2
        best = np.sort(np.argsort(-self.used[: self.n], kind="stable")[:half])
        for at in range(0, len(best), AT_ONCE):  # no place moves up, so none is overwritten before it is read
            part = best[at : at + AT_ONCE]
            self.rows[at : at + len(part)], self.tops[at : at + len(part)] = self.rows[part], self.tops[part]
        keys, used = self.keys[:, best], self.used[best] // 2
        self._start(len(keys))
        self.n = len(best)
        self.keys[:, : self.n], self.used[: self.n] = keys, used
        self._enter(np.arange(self.n))

    def _remember(self, keys: np.ndarray, rows: np.ndarray) -> None:
        if self.n + len(rows) > len(self.rows):
            self._make_room()
        places = np.arange(self.n, min(self.n + len(rows), len(self.rows)))
        self.keys[:, places], self.rows[places], self.used[places] = keys[:, : len(places)], rows[: len(places)], 1
        self.tops[places] = self.rows[places] >> np.uint64(48)
        self.n += len(places)
        self._enter(places)

    def _known(self, places: np.ndarray) -> np.ndarray:
        """The least hash of remembered shingles under each salt."""
        tops = self.tops.take(places, 0)
        salts, at = np.nonzero((tops == tops.min(0)).T)
        return np.minimum.reduceat(self.rows[places[at], salts], np.searchsorted(salts, np.arange(len(self.salted))))

    def _settle(self, pieces: list[tuple[int, str]], k: int, low: np.ndarray) -> None:
        """Lowers the rows of `low` by the shingles of the pieces, each a row and its text."""
        text = "".join(x.ljust(k, "\0") for _, x in pieces)
        size = np.array([max(k, len(x)) for _, x in pieces])
        ends = size.cumsum()
        units = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
        for end, (_, x) in zip(ends.tolist(), pieces, strict=True):
            if len(x) < k:
                units[end - k + len(x) : end] = 0  # no character
        n = len(units) - k + 1
        keys = np.zeros((len(self.keys), n), np.uint64)
        for i in range(k):
            keys[i // PACKED] |= units[i : i + n] << np.uint64(CHAR * (i % PACKED))
        found = self._find(keys)
        fresh = []
        for start, end, (row, x) in zip((ends - size).tolist(), (ends - k + 1).tolist(), pieces, strict=True):
            own = found[start:end]
            missing = np.flatnonzero(own < 0)
            if len(missing):
                fresh += [(row, x[i : i + k], start + i) for i in missing.tolist()]
                own = own[own >= 0]
            if len(own):
                self.used[own] += 1
                low[row] = np.minimum(low[row], self._known(own))
        if fresh:
            first = {x: at for _, x, at in fresh}
            rows = dict(zip(first, map(self.hashes, map(str.encode, first)), strict=True))
            for row, x, _ in fresh:
                np.minimum(low[row], rows[x], out=low[row])
            self._remember(keys[:, list(first.values())], np.stack(list(rows.values())))

    def least(self, texts: list[str], k: int) -> np.ndarray:
        """Per text the least hash of its k-character shingles under each salt; a shorter text is one shingle, an empty one gives zeros."""
        words = -(-k // PACKED)
        if words != len(self.keys):
            self._start(words)
        low = np.full((len(texts), len(self.salted)), 2**64 - 1, "<u8")
        held, size = [], 0
        for row, text in enumerate(texts):
            if not text:
                low[row] = 0
                continue
            for start in range(0, max(1, len(text) - k + 1), AT_ONCE):
                piece = text[start : start + AT_ONCE + k - 1]
                if held and size + len(piece) > AT_ONCE:
                    self._settle(held, k, low)
                    held, size = [], 0
                held.append((row, piece))
                size += max(k, len(piece))
        if held:
            self._settle(held, k, low)
        return low


@functools.lru_cache(maxsize=1)
def minima(perms: int) -> Minima:
    """The table of this process."""
    return Minima(perms)


def signature(text: str, perms: int = 64, k: int = 5) -> list[str]:
    """Minima of salted 64-bit BLAKE2b over k-character shingles, as hex; zeros for an empty text."""
    return [f"{x:016x}" for x in minima(perms).least([text.replace(" ", "")], k)[0].tolist()]


def signed(df: DataFrame, text: str, perms: int = 64, k: int = 5, numbers: bool = False) -> DataFrame:
    """Column `sig` over compare-space texts, exactly as published manifests have it, or with the same 64 bits as signed numbers."""

    @F.arrow_udf("array<long>" if numbers else "array<string>")
    def make(texts: pa.Array) -> pa.Array:
        found = minima(perms).least([(t or "").replace(" ", "") for t in texts.to_pylist()], k)
        if numbers:
            flat = pa.array(found.view("<i8").ravel())
        else:
            ends = np.arange(0, found.size * 16 + 1, 16, dtype=np.int32)
            flat = pa.StringArray.from_buffers(found.size, pa.py_buffer(ends), pa.py_buffer(found.astype(">u8").tobytes().hex().encode()))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, perms, dtype=np.int32)), flat)

    return df.withColumn("sig", make(text))


def word_signed(df: DataFrame, words, perms: int = 16) -> DataFrame:
    """Column `sig` in the JVM: minima of salted MD5 over distinct three-word shingles."""

    def least(grams, p: int):
        salted = F.transform(grams, lambda g: F.left(F.md5(F.concat(F.lit(f"{p}:"), g)), F.lit(16)))
        return F.coalesce(F.array_min(salted), F.lit(""))

    return df.withColumn("sig", C.let(F.array_distinct(C.ngrams(words, 3)), lambda grams: F.array(*[least(grams, p) for p in range(perms)])))


def matches(df: DataFrame, order: str, threshold: float = 0.85) -> DataFrame:
    """(a, b), a before b, of signatures that agree in the threshold's share of slots."""
    rows = df.select(F.col(order).alias("o"), "sig")
    perms = len(rows.select("sig").head()[0]) if rows.head(1) else 1
    bands = perms - math.ceil(threshold * perms - 1e-9) + 1
    cuts = [perms * i // bands for i in range(bands + 1)]
    keyed = rows.select("o", F.explode(F.array(*[F.xxhash64(F.lit(i), F.slice("sig", cuts[i] + 1, cuts[i + 1] - cuts[i])) for i in range(bands)])).alias("key"))
    # ids alone are dealt by band, each pair gets its signatures once
    pairs = keyed.join(keyed.withColumnRenamed("o", "p"), "key").where(F.col("o") < F.col("p")).select("o", "p").distinct()
    both = pairs.join(rows, "o").join(rows.select(F.col("o").alias("p"), F.col("sig").alias("tig")), "p")
    same = F.size(F.filter(F.zip_with("sig", "tig", lambda x, y: x == y), lambda e: e))
    return both.where(same >= threshold * perms).select(F.col("o").alias("a"), F.col("p").alias("b")).distinct()


def firsts(df: DataFrame, order: str, threshold: float = 0.85) -> DataFrame:
    """Column `__o`: the orders that the greedy pass keeps. Equal signatures collapse first, so copies make no pairs."""
    once = written(df.groupBy("sig").agg(F.min(order).alias("__o")))
    open_ = written(matches(once.select(F.col("__o").alias("o"), "sig"), "o", threshold))
    dropped = None
    while open_.head(1):
        starts = open_.select("a").distinct().join(open_.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        gone = written(open_.join(starts, "a").select(F.col("b").alias("x")).distinct())
        dropped = gone if dropped is None else dropped.unionByName(gone)
        rest = open_.join(starts, "a", "left_anti").join(gone.select(F.col("x").alias("a")), "a", "left_anti").join(gone.select(F.col("x").alias("b")), "b", "left_anti")
        open_ = written(rest.select("a", "b"))
    return once.select("__o") if dropped is None else once.select("__o").join(dropped, F.col("__o") == F.col("x"), "left_anti")


def kept(df: DataFrame, order: str, threshold: float = 0.85) -> DataFrame:
    """Rows of `df` that the greedy pass keeps."""
    return df.join(firsts(df, order, threshold), F.col(order) == F.col("__o"), "left_semi")
