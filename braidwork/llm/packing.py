"""Best-fit packing: linear grouping scheme.

Documents become token pieces of at most `capacity` tokens. The plan works on the histogram of
piece lengths, which has at most `capacity` rows however large the corpus is:

1. large lengths are dealt, longest first, into groups of equal cardinality and rounded up to
   the group's longest;
2. for these few sizes, configurations of one sequence are sought one after the other: the
   largest size left and the subset of sizes left that fills the rest best, used as often as
   the counts allow;
3. the actual pieces take the places of their group's rounded size, longest first, which frees
   the difference;
4. small pieces go, longest first, where the least room is left that holds them.

The plan is a list of ranges: pieces of one length with ranks a..b go to sequences s, s+1, ... at
one offset. A broadcast of that list (bounded by the capacity) places every piece.

Defined results. Null or empty text: one piece with the end id alone. A document longer than the
capacity is cut so that its first piece takes the remainder. The string of an added token of the vocabulary
is that token, wherever it stands in a text. Repeated rows are packed each for
itself; ties in length are broken by id, piece and checksum. A null id sorts first. An empty table
gives no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm.columns import running
from braidwork.llm.grouped import released
from braidwork.llm.scratch import Scratch, small_batches

CAPACITY = 1024
END_ID = 2


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@dataclass(frozen=True)
class Encoder:
    """The ids of a byte-level BPE file as the tokenizers library gives them with add_special_tokens=False.

    Ordinary text is run by tiktoken: the same ids, several times faster. A text is cut at the strings of
    the file's added tokens, which stand for their own ids; what lies between them is encoded by itself.
    The tests compare the ids with those of the tokenizers library.
    """

    ordinary: Callable[[str], list[int]]
    added: dict[str, int]
    cuts: re.Pattern | None

    def __call__(self, text: str) -> list[int]:
        if self.cuts is None or not any(x in text for x in self.added):
            return self.ordinary(text)
        ids: list[int] = []
        for part in self.cuts.split(text):
            ids += [self.added[part]] if part in self.added else self.ordinary(part)
        return ids


@cache
def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, one for each Python worker."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    # the alphabet of byte-level BPE: printable bytes stand for themselves, the others follow from 256
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    tokens = held.get("added_tokens", [])
    if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in tokens):
        raise ValueError(f"{path}: added tokens that also match by their surroundings aren't supported")
    added = {x["content"]: x["id"] for x in tokens}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in held["model"]["vocab"].items() if token not in added}
    longest_first = sorted(added, key=lambda x: (-len(x), x))
    cuts = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if added else None
    ordinary = tiktoken.Encoding("braidwork", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return Encoder(ordinary, added, cuts)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32): the token pieces of every document. No shuffle."""
    small_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()
    kind = dict(docs.dtypes)[id_col]

    @released
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            which, out = [], ([], [], [], [])
            for row, text in enumerate(batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), END_ID], "<u4")
                first = len(ids) % capacity or capacity
                bounds = [0, *range(first, len(ids) + 1, capacity)]
                for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    which.append(row)
                    for col, v in zip(out, (i, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                        col.append(v)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=[id_col, "piece", "start", "length", "ids_crc32"])

    return docs.select(id_col, text_col).mapInArrow(cut, f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long")


def fill(room: int, sizes: list[int], left: dict[int, int]) -> list[int]:
    """A multiset of sizes, none more often than `left` says, whose sum comes nearest to `room` from below.

    Reachable sums are the bits of an integer, so a size costs a few shifts.
    """
    full = (1 << room + 1) - 1
    reach, trail = 1, []
    for s in sizes:
        for _ in range(min(left[s], room // s)):
            new = (reach | reach << s) & full
            if new == reach:
                break
            trail.append((s, reach))
            reach = new
        if reach >> room:
            break
    at = reach.bit_length() - 1
    picked = []
    for s, before in reversed(trail):
        if not before >> at & 1:
            picked.append(s)
            at -= s
    return picked


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 256, small: int = 64) -> list[tuple[int, int, int, int, int]]:
    """Ranges (length, rank from, rank to, first sequence, offset) that place all pieces."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    large = sorted((n for n in counts if n > small), reverse=True)
    total = sum(counts[n] for n in large)
    rounded: dict[int, list[int]] = {}  # rounded size: its lengths, longest first
    held, size = 0, 0
    for n in large:
        if not size or held >= total / groups:
            size, held = n, 0
            rounded[size] = []
        rounded[size].append(n)
        held += counts[n]
    left = {s: sum(counts[n] for n in own) for s, own in rounded.items()}
    taken = dict.fromkeys(counts, 0)
    queue = {s: list(own) for s, own in rounded.items()}
    out: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left: runs (first sequence, how many)
    keys: list[int] = []

    def free(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            if room not in rooms:
                rooms[room] = []
                insort(keys, room)
            rooms[room].append((first, n))

    def place(n: int, many: int, first: int, offset: int) -> None:
        out.append((n, taken[n], taken[n] + many, first, offset))
        taken[n] += many

    open_sizes = sorted(left, reverse=True)
    while open_sizes:
        lead = open_sizes[0]
        left[lead] -= 1
        sizes = [s for s in open_sizes if left[s] and s <= capacity - lead]
        config = [lead, *fill(capacity - lead, sizes, left)]
        left[lead] += 1
        times = min(left[s] // config.count(s) for s in set(config))
        for s in config:
            left[s] -= times
        open_sizes = [s for s in open_sizes if left[s]]
        # actual pieces take the places: a run ends where one of its lengths runs out
        first, end = sequences, sequences + times
        sequences = end
        loads = [(first, end, 0)]
        for s in config:
            split: list[tuple[int, int, int]] = []
            for a, b, load in loads:
                while a < b:
                    n = queue[s][0]
                    many = min(b - a, counts[n] - taken[n])
                    if not many:
                        queue[s].pop(0)
                        continue
                    place(n, many, a, load)
                    split.append((a, a + many, load + n))
                    a += many
            loads = split
        for a, b, load in loads:
            free(capacity - load, a, b - a)
    for n in sorted((n for n in counts if n <= small), reverse=True):
        while (rest := counts[n] - taken[n]) > 0:
            i = bisect_left(keys, n)
            if i == len(keys):
                each = capacity // n
                many = max(1, rest // each)
                free(capacity, sequences, many)
                sequences += many
                continue
            room = keys[i]
            first, have = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                keys.pop(i)
            many = min(rest, have)
            place(n, many, first, capacity - room)
            free(room - n, first, many)
            free(room, first + many, have - many)
    return out


def pack(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None, groups: int = 256, small: int = 64) -> DataFrame:
    """`pieces` with their sequence and place in it."""
    scratch = Scratch(spark, "pack")
    cut = scratch.keep(pieces(docs, id_col, text_col, capacity, vocabulary))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `capacity` rows at most
    ranges = spark.createDataFrame(plan(histogram, capacity, groups, small) or [(0, 0, 0, 0, 0)], "_length long, _from long, _to long, _first long, _offset long")
    ranked = running(scratch, cut, ["length"], [id_col, "piece", "ids_crc32", "start"], by_value="_rank")
    here = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    placed = ranked.join(F.broadcast(ranges), here)
    return placed.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("_first") + F.col("_rank") - F.col("_from")).alias("sequence_id"), F.col("_offset").alias("offset"))
