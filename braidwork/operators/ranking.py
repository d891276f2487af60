"""Order-dependent selection that no single task has to see whole.

`running` numbers or sums rows in a total order by range-partitioning them, so a key with most of the rows is
spread over many tasks. The dealt rows are written to the folder in spark.checkpoint.dir, which all executors
share. Only a session whose executors are this machine's own may leave that unset; it gets a temporary folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def require_local(spark: SparkSession) -> None:
    """Machine-local folders serve local masters alone."""
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        require_local(spark)
        found = f"file://{tempfile.mkdtemp(prefix='braidwork-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """The rows, written once and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running(df: DataFrame, keys: list[str], order: list[str], name: str, value: Column | None = None) -> DataFrame:
    """`df` with the exclusive running sum of `value` (row number from 0 if None) within `keys` as column `name`."""
    dealt = written(df.withColumn("__v", (F.lit(1) if value is None else value).cast("long")).repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()))
    totals = dealt.groupBy("__part", *keys).agg(F.sum("__v").alias("__t"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("__part").alias("__p"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    summed = dealt.withColumn("__in", F.coalesce(F.sum("__v").over(inside), F.lit(0))).join(starts, same)
    return summed.select(*df.columns, (F.col("__start") + F.col("__in")).alias(name))


def first_wins(df: DataFrame, keys: list[str], order: str, last: bool = False) -> DataFrame:
    """One row per key: the first (or last) by `order`. Aggregation, so map-side combined, not a sort per key."""
    pick = F.max_by if last else F.min_by
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(pick(F.struct(*rest), F.col(order)).alias("__r")).select(*[F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in df.columns])


def stride(df: DataFrame, order: list[str], step: int, most: int | None = None, offset: int = 0) -> DataFrame:
    """Every `step`-th row in order, `most` at the most."""
    ranked = running(df, [], order, "__n").where(F.col("__n") % step == offset)
    if most is not None:
        ranked = ranked.where(F.col("__n") < offset + step * most)
    return ranked.drop("__n")


#: The bins, in their order.
BINS = ("none", "low", "med", "high")


def quotas(counts: DataFrame, total: int, hard_share: float, bin_col: str = "cmi_bin", bins: tuple[str, ...] = BINS) -> DataFrame:
    """(bin, ord, n, quota) for all bins: observed shares of `total`, at least `hard_share` for the last bin, the others in proportion.

    Rounded half to even; the drift goes to the largest other bin, the first among equals.
    """
    fixed = counts.sparkSession.sql("select * from values " + ", ".join(f"('{b}', {i})" for i, b in enumerate(bins)) + " as t(__bin, ord)")
    rows = fixed.join(counts.select(F.col(bin_col).alias("__c"), "n"), F.col("__bin") == F.col("__c"), "left")
    rows = rows.select(F.col("__bin").alias(bin_col), "ord", F.coalesce("n", F.lit(0)).alias("n"))
    every, hard = Window.partitionBy(), F.col("ord") == len(bins) - 1
    rows = rows.withColumn("__all", F.greatest(F.sum("n").over(every), F.lit(1))).withColumn("__n", F.sum(F.when(hard, F.col("n")).otherwise(0)).over(every))
    own = F.greatest(F.bround(F.lit(total * hard_share)), F.bround(F.lit(total) * F.col("__n") / F.col("__all"))).cast("long")
    rest = F.greatest(F.sum("n").over(every) - F.col("__n"), F.lit(1))
    rows = rows.withColumn("quota", F.when(hard, own).otherwise(F.bround((total - own) * F.col("n") / rest).cast("long")))
    drift = F.lit(total) - F.sum("quota").over(every)
    largest = F.row_number().over(Window.orderBy(hard, F.col("quota").desc(), "ord")) == 1
    return rows.withColumn("quota", F.when(largest, F.greatest(F.lit(0), F.col("quota") + drift)).otherwise(F.col("quota"))).select(bin_col, "ord", "n", "quota")


def fill_quotas(rows: DataFrame, bin_col: str = "cmi_bin") -> DataFrame:
    """(bin, take): the quota or what there is; a shortfall is filled from the largest surplus first."""
    every = Window.partitionBy()
    rows = rows.withColumn("__short", F.sum(F.greatest(F.col("quota") - F.col("n"), F.lit(0))).over(every)).withColumn("__extra", F.greatest(F.col("n") - F.col("quota"), F.lit(0)))
    before = F.coalesce(F.sum("__extra").over(Window.orderBy(F.col("__extra").desc(), "ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = F.greatest(F.lit(0), F.least(F.col("__extra"), F.col("__short") - before))
    return rows.select(bin_col, (F.least("n", "quota") + more).alias("take"))


def balanced(df: DataFrame, total: int, hard_share: float, order: list[str], bin_col: str = "cmi_bin") -> DataFrame:
    """Rows in arrival order up to each bin's share."""
    counts = df.groupBy(bin_col).agg(F.count("*").alias("n"))
    take = fill_quotas(quotas(counts, total, hard_share, bin_col), bin_col)
    ranked = running(df, [bin_col], order, "__n")
    return ranked.join(take, bin_col).where("__n < take").select(*df.columns)


def trimmed(df: DataFrame, target: int, cells: list[str], order: str, seen: str) -> DataFrame:
    """`target` rows, the last of the largest cell dropped again and again; among equals the cell seen first.

    In closed form: with the least level L whose capped sizes reach the target, cells keep min(size, L), and the
    first cells of at least L, in order of appearance, give one more row each until the target is met.
    """
    sizes = df.groupBy(*cells).agg(F.count("*").alias("__size"), F.min(seen).alias("__seen"))
    by_size = Window.orderBy("__size", "__seen")
    rows = sizes.withColumn("__below", F.coalesce(F.sum("__size").over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__upper", F.count("*").over(by_size.rowsBetween(0, Window.unboundedFollowing)))
    level = F.ceil((F.lit(target) - F.col("__below")) / F.col("__upper"))
    every = Window.partitionBy()
    # the first cell, by size, that the level would cut
    found = F.min(F.when(level <= F.col("__size"), F.struct("__size", "__seen", level.alias("level"))))
    rows = rows.withColumn("__level", F.coalesce(found.over(every)["level"], F.max("__size").over(every)))
    rows = rows.withColumn("__kept", F.least("__size", "__level"))
    rows = rows.withColumn("__over", F.greatest(F.sum("__kept").over(every) - target, F.lit(0)))
    turn = F.row_number().over(Window.orderBy(F.col("__size") < F.col("__level"), "__seen"))
    keep = F.col("__kept") - F.when((F.col("__size") >= F.col("__level")) & (turn <= F.col("__over")), 1).otherwise(0)
    caps = rows.select(*cells, keep.alias("__cap"))
    ranked = running(df, cells, [order], "__n")
    same = F.lit(True)
    for c in cells:
        same = same & ranked[c].eqNullSafe(caps[c])
    return ranked.join(caps, same).where("__n < __cap").select(*[ranked[c] for c in df.columns])


def round_robin(df: DataFrame, group: str, order: list[str], total: int) -> DataFrame:
    """Rows taken in turn from each group, the groups by name, `total` in all."""
    ranked = running(df, [group], order, "__n")
    return ranked.orderBy("__n", group).limit(total).drop("__n")


def dealt(df: DataFrame, order: list[str], n: int, group: str | None = None) -> DataFrame:
    """Column `shard`: rows in turn, or groups in turn by their first row in order, each group whole."""
    if group is None:
        return running(df, [], order, "__n").withColumn("shard", F.col("__n") % n).drop("__n")
    firsts = df.groupBy(F.col(group).alias("__g")).agg(F.min(F.struct(*order)).alias("__first"))
    turns = running(firsts, [], ["__first"], "__n").select("__g", (F.col("__n") % n).alias("shard"))
    return df.join(turns, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def seeded(seed: int, key: Column) -> Column:
    """A reproducible draw of a key from 0 to 999,999: the first 32 bits of the MD5 of "seed:key"."""
    return F.conv(F.left(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary")), F.lit(8)), 16, 10).cast("long") % 1_000_000


def split_groups(df: DataFrame, group: str, share: float, seed: int = 7) -> DataFrame:
    """Column `partition`: a share of the groups to dev, whole groups only, by a seeded hash of the group."""
    return df.withColumn("partition", F.when(seeded(seed, F.col(group)) < int(share * 1_000_000), "dev").otherwise("train"))


def split_exact(df: DataFrame, group: str, share: float, seed: int) -> DataFrame:
    """The exact seeded shuffle of the sorted groups, for lists that fit a driver: the first round(n * share) are dev."""
    import random

    ids = sorted(r[0] for r in df.select(group).where(F.col(group).isNotNull()).distinct().collect())
    random.Random(seed).shuffle(ids)
    dev = ids[: round(len(ids) * share)]
    held = df.sparkSession.createDataFrame([(x,) for x in dev], f"__g {dict(df.dtypes)[group]}")
    return df.join(held, F.col(group) == F.col("__g"), "left").withColumn("partition", F.when(F.col("__g").isNotNull(), "dev").otherwise("train")).drop("__g")
