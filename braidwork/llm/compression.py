"""Quality rules: compression bands.

Zstandard ratios (compressed bytes / bytes) of the whole document and of its chunks must
lie inside bands. A document under a band's floor repeats itself; one over its ceiling is noise.
Short texts compress badly by nature, so floor and ceiling follow the length, straight between
points in the logarithm of bytes.

The points stand between the ratios of clean text and those of its opposites, measured at each length on cuts
of the texts that the 0.1 GB table labels clean (four languages in Latin script). From 400 bytes on the floor is
0.95 times the 0.1 % quantile of clean text, below that it lies between clean text and text whose second half
repeats the first. Beyond 25,600 bytes the table has too few texts, and the floor falls to 0.20 at 102,400.
From 1,600 bytes on the ceiling is 1.15 times the 99.9 % quantile. Below that it lies between clean text and
words of random letters and digits, which come near to each other there and meet under 400 bytes. Texts of
which more than half the bytes are beyond ASCII (other scripts) compress otherwise; the table has none to
measure, and they keep wide bands.

Defined results. Null text: no words, so `base_failed`. Empty text: the same, ratio null.
A text shorter than the first point has no compression verdict. One shorter than
the least chunk is judged as a whole only, and its share of bad chunks is null. Rows are judged one by one: repeated rows
give repeated results, an empty table gives an empty one, extra columns are ignored, a null id
stays null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from braidwork.llm.grouped import released
from braidwork.llm.scratch import small_batches


ASCII = bytes(range(128))


@dataclass(frozen=True)
class Bands:
    """`curve`: (bytes, floor, ceiling), ascending; the last holds for all longer texts. `wide`: (bytes from, floor,
    ceiling) in steps, for texts mostly beyond ASCII. A chunk is judged as a text of its size,
    with both limits set off by `chunk_margin`, as a text has many.

    Chunks have at most `chunk_bytes`, in short texts less, but `least_chunk` at least. The last one ends where the
    text ends and counts by the bytes that it adds. A document fails by its chunks if more than `bad_share` of its
    bytes lie in chunks outside.
    """

    curve: tuple[tuple[int, float, float], ...] = (
        (100, 0.700, 0.975), (141, 0.635, 0.875), (200, 0.590, 0.805), (283, 0.565, 0.760), (400, 0.553, 0.728), (566, 0.536, 0.690),
        (800, 0.498, 0.660), (1131, 0.474, 0.640), (1600, 0.457, 0.627), (2263, 0.443, 0.595), (3200, 0.429, 0.570), (4525, 0.419, 0.549),
        (6400, 0.411, 0.531), (9051, 0.403, 0.516), (12800, 0.394, 0.505), (18102, 0.391, 0.492), (25600, 0.380, 0.492), (102400, 0.200, 0.492),
    )
    wide: tuple[tuple[int, float, float], ...] = ((100, 0.25, 1.60), (400, 0.25, 0.95), (1600, 0.22, 0.80), (6400, 0.20, 0.70))
    chunk_bytes: int = 2048
    least_chunk: int = 256
    chunk_margin: float = 0.05
    bad_share: float = 0.3
    level: int = 3
    min_words: int = 50
    max_repeat_percent: int = 50


@dataclass
class _Judge:
    bands: Bands
    zstd: zstandard.ZstdCompressor = field(init=False)

    def __post_init__(self):
        self.zstd = zstandard.ZstdCompressor(level=self.bands.level)
        lengths, self.floors, self.ceilings = zip(*self.bands.curve, strict=True)
        self.at = [math.log2(n) for n in lengths]

    def ratio(self, data: bytes) -> float:
        return len(self.zstd.compress(data)) / len(data)

    def limits(self, n: int) -> tuple[float, float]:
        """Floor and ceiling of a text of n bytes."""
        if n < self.bands.curve[0][0]:
            return -math.inf, math.inf
        at = math.log2(n)
        return float(np.interp(at, self.at, self.floors)), float(np.interp(at, self.at, self.ceilings))

    def wide_limits(self, n: int) -> tuple[float, float]:
        """The same of a text mostly beyond ASCII."""
        return next(((floor, ceiling) for least, floor, ceiling in reversed(self.bands.wide) if n >= least), (-math.inf, math.inf))

    def verdict(self, data: bytes) -> tuple[float | None, float | None, bool]:
        """Ratio of the whole, share of bytes in chunks outside, and whether both are fine."""
        if not data:
            return None, None, True
        limits = self.limits if 2 * len(data.translate(None, ASCII)) <= len(data) else self.wide_limits
        whole = self.ratio(data)
        floor, ceiling = limits(len(data))
        fine = floor <= whole <= ceiling
        size = self.chunk_size(len(data))
        if len(data) < size:
            return whole, None, fine
        low, high = limits(size)
        low, high = low * (1 - self.bands.chunk_margin), high * (1 + self.bands.chunk_margin)
        view = memoryview(data)
        outside = 0
        for at in range(0, len(data), size):
            end = min(at + size, len(data))  # the last chunk reaches back over its neighbour
            if not low <= self.ratio(view[end - size : end]) <= high:
                outside += end - at
        bad = outside / len(data)
        return whole, bad, fine and bad <= self.bands.bad_share

    def chunk_size(self, n: int) -> int:
        """Bytes of the chunks of a text of n bytes: a power of two that gives four chunks or more, within the bounds."""
        return min(self.bands.chunk_bytes, max(self.bands.least_chunk, 1 << max(n // 4, 1).bit_length() - 1))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which occurs at least twice, first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    size = len(seen)
    pairs = ids[:-1] * size + ids[1:]
    if size >= 1 << 20:  # three ids don't fit 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * size + ids[2:]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(windows, twice))
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[starts + k] = True
    return int(covered.sum())


def _measures(text: str | None, judge: _Judge) -> tuple:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()  # bytes.split() knows just the six ASCII white-space characters
    n = len(words)
    spaces = len(data) - len(data.translate(None, b" \t\n\x0b\x0c\r"))
    symbols = len(data) - len(data.translate(None, b"#*$%&|<>"))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    repeats = repeated_words(words)
    failed = n < judge.bands.min_words or 100 * repeats > judge.bands.max_repeat_percent * n
    whole, bad, fine = judge.verdict(data)
    return n, len(text or "") - spaces, symbols, len(lines) - len(set(lines)), repeats, failed, not failed and fine, whole, bad


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, whole_ratio double, bad_chunks double"


def compression_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """One row per document: the base measures, the ratios and the verdict. No shuffle."""
    small_batches(docs.sparkSession)
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    @released
    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge(bands)
        for batch in batches:
            rows = [_measures(x.as_py(), judge) for x in batch.column(1)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[id_col, *names])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(judged, f"{id_col} {kind}, {SCHEMA}")


def keep_good(docs: DataFrame, text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The documents that pass, with all their columns."""
    small_batches(docs.sparkSession)
    schema = docs.schema

    @released
    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _Judge(bands)
        at = schema.names.index(text_col)
        for batch in batches:
            yield batch.filter(pa.array([_measures(x.as_py(), judge)[6] for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(passing, schema)
