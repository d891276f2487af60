"""Best-of-N selection under quality floors, and preference pairs."""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork import session
from braidwork.functions import columns, udfs
from braidwork.functions.columns import harmonic_mean
from braidwork.operators import neardup


@dataclass(frozen=True)
class Weights:
    """What each part of the reward weighs, and the bounds of a sound candidate."""

    accent: float = 1.0
    utmos: float = 0.3
    secs: float = 0.5
    duration: float = 0.1
    f0_std: float = 0.2
    energy_dr: float = 0.1
    silence_cap: float = 0.45
    repeat_cap: float = 0.30
    duration_tolerance: float = 0.15
    secs_margin: float = 0.03
    sink: float = 5.0


def accent(recall: Column, nll: Column) -> Column:
    """Harmonic mean of recall and confidence; 1 where no English word was intended."""
    return F.when(recall.isNull(), F.lit(1.0)).otherwise(harmonic_mean(recall, F.exp(-nll / 3)))


def floors(candidates: DataFrame, group: str = "utt_id") -> DataFrame:
    """Floors of each group from its own candidates; one shuffle on the group."""
    med = lambda c: F.percentile(c, 0.5)
    return candidates.groupBy(group).agg(
        (med("utmos") - 0.10).alias("floor_utmos"), F.coalesce(med("secs") - 0.02, F.lit(1.0)).alias("floor_secs"),
        (F.percentile("f0_std", 0.25) * 0.95).alias("floor_f0_std"), (F.percentile("energy_dr", 0.25) * 0.95).alias("floor_energy_dr"),
        med("dur").alias("floor_dur"), med(accent(F.col("en_recall"), F.col("nll"))).alias("base_racc"),
    )


def rewarded(rows: DataFrame, w: Weights = Weights()) -> DataFrame:
    """r_accent, degenerate, eligible and total of candidates that carry floor_* columns."""
    c = F.col
    below = lambda name, slack=0.0, missing=None: -F.greatest(F.lit(0.0), c(f"floor_{name}") - slack - (c(name) if missing is None else F.coalesce(c(name), F.lit(missing))))
    off = F.abs(c("dur") - c("floor_dur"))
    bad = (c("silence_ratio") > w.silence_cap) | (c("ngram_rep") > w.repeat_cap)
    sound = (
        ~bad & (c("utmos") >= c("floor_utmos")) & (c("secs").isNull() | (c("secs") >= c("floor_secs") - w.secs_margin)) & (c("f0_std") >= c("floor_f0_std"))
        & (c("energy_dr") >= c("floor_energy_dr")) & (off <= w.duration_tolerance * c("floor_dur"))
    )
    r = accent(c("en_recall"), c("nll"))
    total = (
        w.accent * r + w.utmos * below("utmos") + w.secs * below("secs", w.secs_margin, 1.0) - w.duration * off / F.greatest(c("floor_dur"), F.lit(1e-6))
        + w.f0_std * below("f0_std") + w.energy_dr * below("energy_dr") - F.when(bad, w.sink).otherwise(0.0)
    )
    return rows.withColumn("r_accent", F.round(r, 4)).withColumn("degenerate", bad).withColumn("eligible", F.coalesce(sound, F.lit(False))).withColumn("total", F.round(total, 4))


def winners(rows: DataFrame, least_gain: float, group: str = "utt_id", order: str = "cand_id") -> DataFrame:
    """(group, status, winner, loser, gain): the eligible candidate of highest total against the one of lowest accent."""
    best = F.max_by(F.struct(order, "r_accent"), F.struct(F.col("eligible").cast("int"), F.col("total"), -F.col(order)))
    worst = F.min_by(F.struct(order, "r_accent"), F.struct("r_accent", order))
    out = rows.groupBy(group).agg(F.max(F.col("eligible").cast("int")).alias("__any"), best.alias("__w"), worst.alias("__l"), F.first("base_racc").alias("base_racc"))
    gain = F.round(F.col("__w.r_accent") - F.col("base_racc"), 4)
    status = F.when(F.col("__any") == 0, "no_eligible").when(gain < least_gain, "below_gain").otherwise("winner")
    won = F.col("status") == "winner"
    out = out.withColumn("gain", F.when(F.col("__any") == 1, gain)).withColumn("status", status)
    return out.select(
        group, "status", F.when(won, F.col(f"__w.{order}")).alias("winner"), F.when(won & (F.col(f"__l.{order}") != F.col(f"__w.{order}")), F.col(f"__l.{order}")).alias("loser"), "gain"
    )


def best_of_n(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(mean_of_means, mean_of_best): what choosing the best of each group would give."""
    per = rows.groupBy(group).agg(F.avg(value).alias("m"), F.max(value).alias("b"))
    return per.agg(F.avg("m").alias("mean_of_means"), F.avg("b").alias("mean_of_best"))


def every_kth(rows: DataFrame, k: int, group: str, order: str) -> DataFrame:
    """Every k-th row of each group, for replay."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("__n") % k == 0).drop("__n")


def winner_report(won: DataFrame) -> DataFrame:
    """(n_prompts, n_winner, n_no_eligible, n_below_gain, mean_gain) of what `winners` gives; the mean over known gains."""
    count = lambda status: F.count_if(F.col("status") == status).alias(f"n_{status}")
    return won.agg(F.count("*").alias("n_prompts"), *map(count, ("winner", "no_eligible", "below_gain")), F.avg("gain").alias("mean_gain"))


def with_replay(won: DataFrame, pool: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """Winners and, for `share` of their number, rows of the pool in a seeded order; column `origin` tells them apart."""
    from braidwork.operators.ranking import running

    ordered = running(pool.withColumn("__turn", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))), [], ["__turn", key], "__n")
    many = won.agg(F.floor(F.count("*") * share).alias("__many"))  # one row
    replay = ordered.join(F.broadcast(many), F.col("__n") < F.col("__many")).select(*pool.columns)
    return won.withColumn("origin", F.lit("winner")).unionByName(replay.withColumn("origin", F.lit("replay")))


def _any_of(words: tuple[str, ...]) -> str:
    """A pattern of any of the words, by their first letter; nothing matches if there are none."""
    first = lambda w: w[:1]
    return "|".join(f"{re.escape(c)}(?:{'|'.join(re.escape(w[1:]) for w in group)})" for c, group in itertools.groupby(sorted(words), first)) or "(?!)"


def verified(rows: DataFrame, order: str, threshold: float = 0.85, most_roman: int = 1, least_consistency: float = 0.55, hindi_roman: tuple[str, ...] = (), stop: tuple[str, ...] = ()) -> DataFrame:
    """Prompts (text, ref_surface, ...) with `reason` (null: kept), `cs_mode`, `cs_density`, `consistency`: the first check that fails.

    near_duplicate of an earlier kept text, too_short or token_repetition, script_violation_hindi_in_latin,
    ref_surface_mismatch, corrected_bin_low or corrected_bin_none.
    """
    text = F.coalesce("text", F.lit(""))
    once = session.dealt(rows.groupBy(text.alias("__t")).agg(F.min(order).alias("__first")), "__first")  # copies are signed once
    signed = neardup.signed(once.withColumn("__c", udfs.compare_space("__t")), "__c", numbers=True)
    first = neardup.firsts(signed.select("__first", "sig"), "__first", threshold)
    lists = [F.array(*map(F.lit, x)).cast("array<string>") for x in (hindi_roman, stop)]
    tagged = F.transform(columns.tokens(text), lambda t: F.struct(t.alias("t"), columns.lexicon_tag(t, *lists).alias("g")))
    roman = lambda m: F.size(F.filter(m, lambda x: (x["g"] == "hi") & x["t"].rlike(r"^[A-Za-z'\-]+$")))
    mixed = lambda m: columns.let(F.transform(m, lambda x: x["g"]), lambda g: F.struct(columns.mixing_bin(columns.mixing_index(g)).alias("bin"), columns.switch_density(g).alias("density")))
    marks = columns.let(tagged, lambda m: F.struct(roman(m).alias("roman"), mixed(m).alias("mixed")))
    # without Devanagari and without a listed word that no letters touch, a text has no Hindi
    some = text.rlike(columns.DEVA) | F.lower(text).rlike(rf"(?<![a-z])(?:{_any_of((*hindi_roman, *stop))})(?![a-z])")
    plain = F.struct(F.lit(0).alias("roman"), F.struct(F.lit("none").alias("bin"), F.lit(0.0).alias("density")).alias("mixed"))
    out = rows.withColumn("__m", F.when(some, marks).otherwise(plain)).withColumn("__degenerate", columns.degenerate(text))
    out = out.withColumn("cs_mode", F.col("__m.mixed.bin")).withColumn("cs_density", F.round("__m.mixed.density", 3))
    # the reason needs no full similarity, which is left out where nobody asks for it
    out = out.withColumn("consistency", F.round(udfs.similarity("text", "ref_surface"), 2)).withColumn("__similar", udfs.similar(least_consistency)("text", "ref_surface"))
    own = (
        F.when(F.col("__degenerate") != "", F.col("__degenerate")).when(F.col("__m.roman") > most_roman, "script_violation_hindi_in_latin")
        .when(~F.col("__similar"), "ref_surface_mismatch").when(~F.col("cs_mode").isin("high", "med"), F.concat(F.lit("corrected_bin_"), "cs_mode"))
    )
    judged = out.withColumn("__own", own).join(first, F.col(order) == F.col("__o"), "left")  # texts that aren't asked for aren't shuffled
    return judged.withColumn("reason", F.when(F.col("__o").isNull(), "near_duplicate").otherwise(F.col("__own"))).select(*rows.columns, "reason", "cs_mode", "cs_density", "consistency")
