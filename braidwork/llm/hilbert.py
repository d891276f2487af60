"""Sharding by Hilbert-curve ordering, in DataFrame operations only.

Language, source and size are each quantised to 16 cells by equi-depth cut points over whole values; the
cells of the cube get their place on the Hilbert curve from a table of 4,096 entries; rows sort by that
place, and runs of the order become shards. A run of the curve is a compact region of the cube, the more so
the shorter it is: eight shards halve each dimension at most, and a value that most rows share (a language)
stands in most shards. Files cut finer, as `write_shards` does by rows, prune on any of the three.

Law: `rows`. Cut points come from aggregations over all rows and are fixed before rows are
placed. No task holds a whole cell: rows are dealt by range of (place, id, text tag).

Defined results. Null text: size 1, checksum 0. Null language or source: below all
others, the empty string included. Ties in place are ordered by id (null first) and a 64-bit tag of the text; rows alike in both take
their slots in no stated order, so that the set of their results is fixed, but not which row has which. An
empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm.columns import running, text_tag
from braidwork.llm.scratch import Scratch

BITS = 4
CUTS = 1 << BITS


def curve_place(cell: tuple[int, ...], bits: int = BITS) -> int:
    """Index of a cell on the Hilbert curve in len(cell) dimensions.

    From the top bit down, each level's corner is a Gray code; the orientation of the sub-cube is
    kept as an entry corner and a rotation of the axes.
    """
    n = len(cell)
    full = (1 << n) - 1
    rot = lambda x, k: (x >> k % n | x << n - k % n) & full  # noqa: E731  to the right
    entry, turn, place = 0, 0, 0
    for level in range(bits - 1, -1, -1):
        corner = sum((c >> level & 1) << i for i, c in enumerate(cell))
        gray = rot(corner ^ entry, turn + 1)
        step = gray
        for shift in (1, 2, 4, 8):
            step ^= step >> shift
        place = place << n | step
        start = 0 if step == 0 else (step - 1 & ~1) ^ ((step - 1 & ~1) >> 1)
        entry ^= rot(start, n - (turn + 1) % n)
        pair = step - 1 if step and not step & 1 else step
        ones = (pair ^ pair + 1).bit_length() - 1 if step else 0
        turn = (turn + ones % n + 1) % n
    return place


def table(dims: int = 3, bits: int = BITS) -> list[int]:
    """Places of all cells; a cell's number has `bits` bits for each dimension."""
    mask = (1 << bits) - 1
    return [curve_place(tuple(i >> bits * d & mask for d in range(dims)), bits) for i in range(1 << bits * dims)]


def string_cuts(scratch: Scratch, rows: DataFrame, column: str) -> list[str | None]:
    """Equi-depth cut points of a string column: for each sixteenth of all rows the value that reaches it.

    Whole values count, in order of code points, by their frequencies; values are distinct, so a hot one is one row
    of the running sum. At most `CUTS` - 1 values reach the driver. A null lies below all others.
    """
    counted = scratch.keep(rows.groupBy(column).agg(F.count("*").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    summed = running(scratch, counted.withColumn("_some", F.col(column).isNotNull()), [], ["_some", column], F.col("n"), by_value="_at")
    # the points i * total / CUTS that lie in the value's rows: those after the rows before it, up to its last
    first, last = F.expr(f"_at * {CUTS} div {max(1, total)} + 1"), F.expr(f"(_at + n) * {CUTS} div {max(1, total)}")
    points = summed.select(column, first.alias("a"), F.least(last, F.lit(CUTS - 1)).alias("b")).where("a <= b")
    return [r[0] for r in sorted(points.collect(), key=lambda r: r["a"]) for _ in range(r["b"] - r["a"] + 1)]


def hilbert_order(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(id, tag, size, text_crc32, cell, place) of every row; texts are read once."""
    raw = F.encode(F.col(text_col), "utf-8")
    rows = scratch.keep(
        docs.select(
            F.col(id_col).alias("_id"),
            text_tag(text_col).alias("_tag"),
            (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(raw), F.lit(0)).alias("text_crc32"),
            F.col(lang_col).alias("_a"),
            F.col(source_col).alias("_b"),
        )
    )
    points = [i / CUTS for i in range(1, CUTS)]
    sizes = rows.agg(F.percentile_approx("size", points, 10_000)).first()[0] or []  # one row of 15 numbers
    cuts = {"_a": string_cuts(scratch, rows, "_a"), "_b": string_cuts(scratch, rows, "_b"), "size": sizes}
    cell = F.lit(0)
    for i, (c, at) in enumerate(cuts.items()):
        # a value that fills several sixteenths is one cell, and the next value stands as far behind it
        over = lambda cut: F.col(c).isNotNull() if cut is None else F.col(c) > F.lit(cut)  # noqa: B023, E731
        above = sum((F.when(over(cut), n).otherwise(0) for cut, n in Counter(at).items()), start=F.lit(0))
        cell = cell + F.shiftleft(above, i * BITS)
    places = F.split(F.lit(",".join(map(str, table(len(cuts))))), ",")
    return rows.select("_id", "_tag", "size", "text_crc32", cell.alias("cell")).withColumn("place", F.get(places, F.col("cell")).cast("int"))


def hilbert_shards(
    spark: SparkSession, docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """One row per document: its shard and gapless slot; counts of shards differ by one at most."""
    scratch = Scratch(spark, "hilbert")
    ordered = hilbert_order(docs, scratch, id_col, text_col, lang_col, source_col)
    ranked = running(scratch, ordered, [], ["place", "_id", "_tag"], by_value="_rank")
    n = max(1, ranked.count())
    exact = F.expr(f"_rank * {shards} div {n}").cast("int")
    first = F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")
    return (
        ranked.withColumn("shard", exact)
        .withColumn("slot", F.col("_rank") - first)
        .select(
            F.col("_id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "cell", "place",
        )
    )


def write_shards(spark: SparkSession, docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", folder: str = "curve_shard") -> None:
    """Write the documents as Parquet, one folder per shard, in curve order for pruning by file statistics.

    A row without an id can't be told from others of the same text and takes the lowest shard of them.
    """
    scratch = Scratch(spark, "hilbert-write")
    ordered = hilbert_order(docs, scratch, id_col, text_col, lang_col, source_col)
    ranked = running(scratch, ordered, [], ["place", "_id", "_tag"], by_value="_rank")
    n = max(1, ranked.count())
    dealt = ranked.groupBy("_id", "_tag").agg(F.min("_rank").alias("__bw_rank")).withColumn("__bw_shard", F.expr(f"__bw_rank * {shards} div {n}").cast("int"))
    own = docs.withColumn("__bw_tag", text_tag(text_col))
    dealt = dealt.select(F.col("_id").alias("__bw_i"), F.col("_tag").alias("__bw_t"), "__bw_rank", "__bw_shard")
    joined = own.join(dealt, F.col(id_col).eqNullSafe(F.col("__bw_i")) & (F.col("__bw_tag") == F.col("__bw_t")))
    spread = joined.repartitionByRange("__bw_shard", "__bw_rank").sortWithinPartitions("__bw_shard", "__bw_rank")
    name = folder if folder not in docs.columns else f"{folder}_"
    spread.select(*docs.columns, F.col("__bw_shard").alias(name)).write.mode("overwrite").partitionBy(name).parquet(path)
