"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.llm.scratch import Scratch

#: Fixed values of the contracts: ASCII white space, and A-Z with their lower case.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_tag(text: Column | str) -> Column:
    """A 64-bit tag of a text; with the id it names a row, even if ids repeat."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.isNull(), F.lit(0)).otherwise(F.xxhash64(text))


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def running(scratch: Scratch, df: DataFrame, keys: list[str], order: list[str], value: Column | None = None, by_value: str = "before") -> DataFrame:
    """`df` with the exclusive running sum of `value` (a row number from 0 if None) within `keys`, ordered by `order`.

    No task sees a whole key: rows are range-partitioned by keys and order and written once, so
    that the dealing can't change on a retry; each dealt part sums its own rows, and the parts'
    totals (one row per part and key) give the offsets. `order` must be total for a stable result.
    """
    value = F.lit(1) if value is None else value
    dealt = scratch.keep(
        df.withColumn("_v", value.cast("long")).repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    )
    totals = dealt.groupBy("_part", *keys).agg(F.sum("_v").alias("_t"))
    back = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_t").over(back), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0))).withColumnRenamed("_part", "_p")
    same = F.col("_p") == F.col("_part")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    # a row for each part, or part and key where a key ends: far fewer than rows
    return summed.join(starts, same).withColumn(by_value, F.col("_start") + F.col("_in")).drop("_part", "_p", "_v", "_in", "_start", *[f"_k{i}" for i in range(len(keys))])


def sieve(df: DataFrame, key: str, wanted: DataFrame, bits: int = 1 << 25) -> DataFrame:
    """Rows of `df` whose `key` may be among the one column of `wanted`: none is lost, few others stay.

    A Bloom filter of one hash in a bitmap of fixed size, so what is broadcast is bounded: 4 MB. Put before a
    semi-join it spares the shuffle of rows that the join would drop; once full it passes everything.
    """
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(bits))
    own = wanted.select(place(F.col(wanted.columns[0])).alias("_p"))
    maps = own.groupBy(F.expr("_p div 32768").alias("_b")).agg(F.bitmap_construct_agg(F.expr("_p % 32768")).alias("_map"))
    found = df.withColumn("_p", place(F.col(key))).join(F.broadcast(maps), F.expr("_p div 32768 = _b"))
    byte = F.expr("cast(conv(hex(substring(_map, cast(_p % 32768 div 8 as int) + 1, 1)), 16, 10) as int)")
    return found.where((byte.bitwiseAND(F.expr("shiftleft(1, cast(_p % 8 as int))")) != 0)).select(*df.columns)
