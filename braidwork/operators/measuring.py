"""Aggregations: distributions, sweeps, calibration, diversity, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.operators.ranking import running


def quantiles(df: DataFrame, value: str, shares: tuple[float, ...], *keys: str) -> DataFrame:
    """(keys, q): linear percentiles of a column. Equal values are counted first, then ranked by range-partitioned
    running sums, so that no task holds the values of a key."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__x")).agg(F.count("*").alias("__c"))
    ranked = running(counted, [*keys], ["__x"], "__before", F.col("__c"))
    sizes = counted.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.sum("__c").alias("__size"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    rows = ranked.join(F.broadcast(sizes) if not keys else sizes, same)
    place = lambda share: F.lit(share) * (F.col("__size") - 1)
    holds = lambda at: (F.col("__before") <= at) & (at < F.col("__before") + F.col("__c"))
    ends = [F.max(F.when(holds(end(place(share))), F.col("__x"))).alias(f"__{i}{side}") for i, share in enumerate(shares) for side, end in (("a", F.floor), ("b", F.ceil))]
    found = rows.groupBy(*keys).agg(F.max("__size").alias("__size"), *ends)
    between = [F.col(f"__{i}a") + (F.col(f"__{i}b") - F.col(f"__{i}a")) * (place(share) - F.floor(place(share))) for i, share in enumerate(shares)]
    return found.select(*keys, F.array(*between).alias("q"))


def described(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Count, mean, extremes and linear percentiles of a column, zero where there is nothing."""
    rest = df.groupBy(*[F.col(k).alias(f"__o{i}") for i, k in enumerate(keys)]).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__o{i}"))
    out = rest.join(quantiles(df, value, (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95), *keys), same, "left")
    names = ("p05", "p10", "p25", "p50", "p75", "p90", "p95")
    zero = lambda c, name: F.coalesce(c.cast("double"), F.lit(0.0)).alias(name)
    return out.select(*[F.col(f"__o{i}").alias(k) for i, k in enumerate(keys)], "n", zero(F.col("mean"), "mean"), zero(F.col("least"), "least"), zero(F.col("most"), "most"), *[zero(F.get("q", F.lit(i)), n) for i, n in enumerate(names)])


def swept(df: DataFrame, recalls: list[float], cers: list[float], recall: str = "recall", cer: str = "cer") -> DataFrame:
    """(tau_recall, tau_cer, kept, rate) over a grid, in one pass: conditional sums, then unfolded."""
    grid = [(r, c) for r in recalls for c in cers]
    sums = [F.sum(((F.col(recall) >= r) & (F.col(cer) <= c)).cast("long")).alias(f"s{i}") for i, (r, c) in enumerate(grid)]
    row = df.agg(F.count("*").alias("__n"), *sums)
    cells = F.array(*[F.struct(F.lit(r).alias("tau_recall"), F.lit(c).alias("tau_cer"), F.coalesce(F.col(f"s{i}"), F.lit(0)).alias("kept")) for i, (r, c) in enumerate(grid)])
    return row.select("__n", F.explode(cells).alias("c")).select("c.*", F.coalesce(F.try_divide(F.col("c.kept"), F.col("__n")), F.lit(0.0)).alias("rate"))


def calibrated(df: DataFrame, least_recall: float = 0.6, most_cer: float = 0.5, recall: str = "recall", cer: str = "cer") -> DataFrame:
    """(tau_recall, tau_cer, n, kept): thresholds at the tenth and ninetieth percentiles, bounded, and what they keep."""
    low, high = quantiles(df, recall, (0.1,)), quantiles(df, cer, (0.9,)).withColumnRenamed("q", "r")
    tau = low.crossJoin(F.broadcast(high)).select(
        F.round(F.greatest(F.lit(least_recall), F.get("q", F.lit(0))), 3).alias("tau_recall"), F.round(F.least(F.lit(most_cer), F.get("r", F.lit(0))), 3).alias("tau_cer")
    )
    both = df.select(recall, cer).crossJoin(F.broadcast(tau))  # one row
    keep = (F.col(recall) >= F.col("tau_recall")) & (F.col(cer) <= F.col("tau_cer"))
    return both.groupBy("tau_recall", "tau_cer").agg(F.count("*").alias("n"), F.sum(keep.cast("long")).alias("kept"))


def entropy(df: DataFrame, words: Column, *keys: str) -> DataFrame:
    """(keys, n_tokens, n_types, entropy): bits of the word distribution. Two counted phases; no vocabulary is collected."""
    counts = df.select(*keys, F.explode(words).alias("__w")).groupBy(*keys, "__w").agg(F.count("*").alias("__c"))
    # sum of -p log p, with p = c / n, from sums of c and c log c
    sums = counts.groupBy(*keys).agg(F.sum("__c").alias("n_tokens"), F.count("*").alias("n_types"), F.sum(F.col("__c") * F.log2(F.col("__c"))).alias("__cl"))
    return sums.select(*keys, "n_tokens", "n_types", (F.log2("n_tokens") - F.col("__cl") / F.col("n_tokens")).alias("entropy"))


def eroded(corpus: DataFrame, real: DataFrame, least: float = 0.85) -> DataFrame:
    """(entropy, real_entropy, ratio, alarm) of two entropy rows."""
    both = corpus.select("entropy").crossJoin(F.broadcast(real.select(F.col("entropy").alias("real_entropy"))))
    ratio = F.try_divide(F.col("entropy"), F.col("real_entropy"))
    return both.select("entropy", "real_entropy", ratio.alias("ratio"), (ratio < least).alias("alarm"))


def grouped_report(df: DataFrame, keys: list[str], *measures: Column) -> DataFrame:
    """The measures over all rows and by each key alone: grouping sets over one scan. `grouping` names the set."""
    sets = [[], *[[F.col(k)] for k in keys]]
    which = F.lit("all")
    for k in keys:
        which = F.when(F.grouping(k) == 0, F.lit(k)).otherwise(which)
    value = F.coalesce(*[F.when(F.grouping(k) == 0, F.coalesce(F.col(k).cast("string"), F.lit("None"))) for k in keys], F.lit(""))
    return df.groupingSets(sets, *[F.col(k) for k in keys]).agg(which.alias("grouping"), value.alias("value"), *measures).drop(*keys)


def bin_deltas(a: DataFrame, b: DataFrame, key: str, measure: str) -> DataFrame:
    """(key, a, b, delta) of two reports; a side that lacks the key gives a null delta."""
    left, right = a.select(key, F.col(measure).alias("a")), b.select(key, F.col(measure).alias("b"))
    return left.join(right, key, "full").withColumn("delta", F.col("b") - F.col("a"))


def commonest(df: DataFrame, group: list[str], value: str, weight: Column, order: Column) -> DataFrame:
    """The value of most weight in each group; the one seen first among equals."""
    sums = df.groupBy(*group, value).agg(F.sum(weight).alias("weight"), F.min(order).alias("__o"))
    best = F.max_by(F.struct(value, "weight"), F.struct(F.col("weight"), -F.col("__o"))).alias("__b")
    return sums.groupBy(*group).agg(best).select(*group, f"__b.{value}", "__b.weight")


def dimension_means(df: DataFrame, vector: str, top: int) -> DataFrame:
    """(dim, l1, rank): mean absolute value of each dimension of a vector column, the `top` largest."""
    dims = df.select(F.posexplode(vector).alias("dim", "__x")).groupBy("dim").agg(F.avg(F.abs(F.col("__x").cast("double"))).alias("l1"))
    return dims.withColumn("rank", F.row_number().over(Window.orderBy(F.col("l1").desc(), "dim"))).where(F.col("rank") <= top)


def holm(axes: DataFrame, alpha: float, p: str = "p") -> DataFrame:
    """Holm's step-down over the axes: threshold alpha / (k - i) by rank i, and rejection until the first failure."""
    order = Window.orderBy(p, "axis")
    rows = axes.withColumn("rank", F.row_number().over(order)).withColumn("threshold", F.lit(alpha) / (F.count("*").over(Window.partitionBy()) - F.col("rank") + 1))
    return rows.withColumn("rejected", F.min((F.col(p) <= F.col("threshold")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1)


def benjamini_hochberg(df: DataFrame, q: float = 0.10) -> DataFrame:
    """(axis, p, rank, threshold, flagged) under a false discovery rate; a handful of slices, so one window."""
    ranked = df.withColumn("rank", F.row_number().over(Window.orderBy("p", "axis"))).withColumn("threshold", q * F.col("rank") / F.count("*").over(Window.partitionBy()))
    later = Window.orderBy("rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return ranked.withColumn("flagged", F.max(F.col("p") <= F.col("threshold")).over(later))


def variance_parts(df: DataFrame, axis: str, unit: str, value: str) -> DataFrame:
    """(axis, between, within, icc): one-way random effects of units with repeated scores; two aggregations, no group held."""
    v = F.col(value).cast("double")
    per = df.where(F.col(value).isNotNull()).groupBy(axis, unit).agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    t = per.groupBy(axis).agg(F.count("*").alias("a"), F.sum("n").alias("N"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum("s").alias("S"), F.sum("q").alias("Q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("B"))
    t = t.withColumn("within", F.try_divide(F.col("Q") - F.col("B"), F.col("N") - F.col("a")))
    msb = F.try_divide(F.col("B") - F.col("S") * F.col("S") / F.col("N"), F.col("a") - 1)
    n0 = F.try_divide(F.col("N") - F.col("n2") / F.col("N"), F.col("a") - 1)
    t = t.withColumn("between", F.greatest(F.lit(0.0), F.try_divide(msb - F.col("within"), n0)))
    return t.select(axis, "between", "within", F.try_divide("between", F.col("between") + F.col("within")).alias("icc"))


def flag(flags: Column, name: str, missing: str = "unknown") -> Column:
    """The value of the first flag `name:value`."""
    first = F.get(F.filter(flags, lambda x: x.startswith(f"{name}:")), F.lit(0))
    return F.coalesce(F.substring(first, len(name) + 2, 1 << 30), F.lit(missing))


def histograms(df: DataFrame, **kinds: Column) -> DataFrame:
    """(kind, value, n): counts of the values of several columns in one pass."""
    cells = F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("value")) for k, c in kinds.items()])
    return df.select(F.explode(cells).alias("c")).groupBy("c.kind", "c.value").agg(F.count("*").alias("n"))


def repetition_alarms(df: DataFrame, rep: str = "rep_4gram") -> DataFrame:
    """(mean_rep, n_repeating): the mean repetition, nulls as zero, and the rows that repeat anything."""
    value = F.coalesce(F.col(rep), F.lit(0.0))
    return df.agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean_rep"), F.count_if(value > 0).alias("n_repeating"))


def collapse(student: DataFrame, gold: DataFrame) -> DataFrame:
    """Entropy and repetition of two one-row measures (entropy, rep), and the student's less the gold's."""
    both = student.select(F.col("entropy").alias("student_entropy"), F.col("rep").alias("student_rep")).crossJoin(F.broadcast(gold.select(F.col("entropy").alias("gold_entropy"), F.col("rep").alias("gold_rep"))))
    return both.withColumn("entropy_delta", F.col("student_entropy") - F.col("gold_entropy")).withColumn("rep_delta", F.col("student_rep") - F.col("gold_rep"))


def longest_runs(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, longest): the longest run of equal neighbours in order. Numbers within a key and within a key's value differ by
    a constant along a run; both come from range-partitioned running counts, so that no task sees a whole key."""
    rows = running(running(df.select(key, order, value), [key], [order], "__n"), [key, value], [order], "__m")
    runs = rows.groupBy(key, value, (F.col("__n") - F.col("__m")).alias("__run")).agg(F.count("*").alias("__c"))
    return runs.groupBy(key).agg(F.max("__c").alias("longest"))
