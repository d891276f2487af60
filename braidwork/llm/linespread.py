"""Line dedup by distinct-site spread, in DataFrame operations only.

A line that stands on many sites is boilerplate. Lines are named by 128 bits of hash; a first
aggregation keeps those seen on two sites or more; HyperLogLog sketches of their sites merge by
aggregation; estimates far from the threshold decide, and lines near it get exact distinct
counts. Of a boilerplate line the first occurrence (lowest id, text tag, position) stays, all
others go, so a document that was copied to many sites survives once.

Defined results. Lines without a word are never removed. A null source is a site of its own.
Null text: no lines, nothing removed, text stays null. Empty text: one blank line. Identical rows
(id and text) count as one document and get the same result. A null id sorts first. An empty
table gives no rows; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm.columns import text_tag
from braidwork.llm.scratch import Scratch

MIN_SITES = 10
LG_K = 12
#: Columns that are added; unlikely to clash with those of a table.
N_LINES, N_REMOVED = "__bw_n_lines", "__bw_n_removed"
#: Relative error that the sketches are trusted to: over four standard errors of 4,096 registers.
MARGIN = 0.07


def _lines(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    exploded = docs.select(
        F.col(id_col).alias("_id"), text_tag(text_col).alias("_tag"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("")).alias("_site"),
        F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("_pos", "_line"),
    )
    named = exploded.where(F.col("_line").rlike(r"[^\x20\x09-\x0D]"))
    return named.select("_id", "_tag", "_site", "_pos", F.xxhash64("_line").alias("_h1"), F.xxhash64(F.lit("second"), "_line").alias("_h2"))


def boilerplate(scratch: Scratch, lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, margin: float = MARGIN) -> DataFrame:
    """(_h1, _h2, _first): the lines on `min_sites` sites or more and where each stands first."""
    key = ["_h1", "_h2"]
    seen = lines.groupBy(*key).agg(F.min("_site").alias("_a"), F.max("_site").alias("_b"), F.count("*").alias("_n"), F.min(F.struct("_id", "_tag", "_pos")).alias("_first"))
    spread = scratch.keep(seen.where(f"_a <> _b and _n >= {min_sites}").select(*key, "_first") if min_sites > 1 else seen.select(*key, "_first"))
    some = lines.join(spread.select(*key), key, "left_semi").select(*key, "_site")
    sketches = some.groupBy(*key).agg(F.hll_sketch_agg("_site", lg_k).alias("_sketch"))
    guess = scratch.keep(sketches.select(*key, F.hll_sketch_estimate("_sketch").alias("_sites")))
    near = guess.where(F.col("_sites").between(min_sites * (1 - margin) - 1, min_sites * (1 + margin) + 1)).select(*key)
    exact = some.join(near, key, "left_semi").groupBy(*key).agg(F.count_distinct("_site").alias("_sites")).where(F.col("_sites") >= min_sites)
    sure = guess.where(F.col("_sites") > min_sites * (1 + margin) + 1)
    found = sure.select(*key).unionByName(exact.select(*key))
    return spread.join(found, key)


def strip_boilerplate(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K, margin: float = MARGIN
) -> DataFrame:
    """The documents with their text stripped, and two counts."""
    scratch = Scratch(spark, "lines")
    lines = scratch.keep(_lines(docs, id_col, text_col, source_col))
    bad = boilerplate(scratch, lines, min_sites, lg_k, margin)
    again = lines.join(bad, ["_h1", "_h2"]).where(~F.struct("_id", "_tag", "_pos").eqNullSafe(F.col("_first")))
    gone = again.groupBy("_id", "_tag").agg(F.collect_set("_pos").alias("__bw_gone")).withColumnsRenamed({"_id": "__bw_i", "_tag": "__bw_t"})
    own = docs.withColumn("__bw_tag", text_tag(text_col))
    joined = own.join(gone, F.col(id_col).eqNullSafe(F.col("__bw_i")) & (F.col("__bw_tag") == F.col("__bw_t")), "left")
    parts = F.split(F.col(text_col), "\n", -1)
    # a set difference of positions, then one look-up for each line that stays: linear in the lines of a text
    stays = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__bw_gone"))
    bound = F.array(F.struct(parts.alias("lines"), stays.alias("stays")))  # bound by a lambda, so that no line splits the text again
    left = F.get(F.transform(bound, lambda b: F.array_join(F.transform(b["stays"], lambda i: F.get(b["lines"], i)), "\n")), 0)
    stripped = F.when(F.col("__bw_gone").isNull(), F.col(text_col)).otherwise(left).alias(text_col)
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return joined.select(*[stripped if c == text_col else F.col(c) for c in docs.columns], size(parts).alias(N_LINES), size(F.col("__bw_gone")).alias(N_REMOVED))
