"""Joins whose key and null rules matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidwork.operators.ranking import first_wins


def truthy(c: Column, kind: str) -> Column:
    """Null for what counts as missing: empty strings and empty lists, not zeros."""
    if kind == "string":
        return F.nullif(c, F.lit(""))
    return F.when(F.size(c) > 0, c) if kind.startswith("array") else c


def enriched(left: DataFrame, right: DataFrame, key: str, order: str, columns: list[str], last: bool = False, literal: tuple[str, ...] = ()) -> DataFrame:
    """Left rows, with `columns` from the left where present, else from the first (or last) right row of the key.

    `literal` columns are taken from the left unless null; the others also fall through when empty.
    """
    once = first_wins(right, [key], order, last).select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = left.join(once, F.col(key) == F.col("__k"), "left")
    kinds = dict(left.dtypes)
    pick = lambda c: F.coalesce(F.col(c) if c in literal else truthy(F.col(c), kinds[c]), F.col(f"__{c}")).alias(c)
    return joined.select(*[pick(c) if c in columns else F.col(c) for c in left.columns])


def with_fallback(probe: DataFrame, lookup: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """`columns` from the last lookup row of the key, or all from the probe row itself if there is none."""
    once = first_wins(lookup, [key], order, last=True).select(F.col(key).alias("__k"), F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = probe.join(once, F.col(key) == F.col("__k"), "left")
    return joined.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in probe.columns])


def compared(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """(key, side): both, left or right, duplicates collapsed; one full join serves match and both differences."""
    a = left.groupBy(key).agg(F.max(order).alias("__a"))
    b = right.groupBy(key).agg(F.max(order).alias("__b"))
    side = F.when(F.col("__b").isNull(), "left").when(F.col("__a").isNull(), "right").otherwise("both")
    return a.join(b, key, "full").select(key, side.alias("side"))


def remaining(plan: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Plan rows whose key isn't done yet."""
    return plan.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def without_leaks(pool: DataFrame, *held: DataFrame, text: str = "text") -> DataFrame:
    """Pool rows whose trimmed text stands in none of the held-out sets."""
    out = pool.withColumn("__t", F.trim(text))
    for h in held:
        out = out.join(h.select(F.trim(text).alias("__t")).distinct(), "__t", "left_anti")
    return out.select(*pool.columns)


def expanded(rows: DataFrame, voices: list[str], speeds: list[float], tiers: list[str | None]) -> DataFrame:
    """Each row with text and chunks once per voice, speed and tier; an unfolding of small literals, not a join."""
    usable = rows.where((F.coalesce(F.length(F.trim("text")), F.lit(0)) > 0) & (F.size("chunks") > 0))
    tier = F.array_distinct(F.transform(F.array(*[F.lit(t).cast("string") for t in tiers]), lambda t: F.when(F.lower(t).isin("", "none", "null", "default"), None).otherwise(t)))
    out = usable.withColumn("voice", F.explode(F.array(*map(F.lit, voices)))).withColumn("speed", F.explode(F.array(*map(F.lit, speeds))))
    return out.withColumn("temp_tier", F.explode(tier))


def paired(scores: DataFrame, ref: str, cand: str) -> DataFrame:
    """(axis, utt_id, ref, cand, delta) of long-form scores; null scores and lone ids are dropped before pairing."""
    known = scores.where(F.col("value").isNotNull())
    side = lambda s: F.max(F.when(F.col("system") == s, F.col("value")))
    both = known.where(F.col("system").isin(ref, cand)).groupBy("axis", "utt_id").agg(side(ref).alias("ref"), side(cand).alias("cand"))
    return both.where("ref is not null and cand is not null").withColumn("delta", F.col("cand") - F.col("ref"))


def base_and_candidate(base: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Every row of the base panel with its candidate's columns, null where it has none."""
    return base.join(candidates, key, "left")
