"""Connected components of a graph that may be as large as the corpus.

Alternating large-star and small-star steps: each node hooks its larger, then its smaller neighbours
to the least neighbour it knows. Every step is a join on a node and an aggregation; no neighbourhood
is collected, and each round is written out, so that a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.scratch import Scratch


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _least(scratch: Scratch, pairs: DataFrame) -> DataFrame:
    """Written, so that the join that follows is one of plain exchanges: a node of very many edges is then split over tasks."""
    return scratch.keep(pairs.groupBy("u").agg(F.min("v").alias("m")))


def components(scratch: Scratch, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (a, b: long) that isn't the least of its component."""
    least, greatest = F.least("a", "b"), F.greatest("a", "b")
    now = scratch.keep(edges.where("a <> b").select(greatest.alias("a"), least.alias("b")).distinct())
    mark = _mark(now)
    for _ in range(rounds if mark[0] else 0):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        near = _least(scratch, both)
        large = both.where("v > u").join(near, "u").select(F.col("v").alias("a"), F.least("u", "m").alias("b")).where("a <> b").distinct()
        large = scratch.keep(large)
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        low = _least(scratch, down)
        hooked = down.join(low, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        small = hooked.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        new = scratch.keep(small)
        for old in (now, near, large, low):
            scratch.drop(old)
        now, before, mark = new, mark, _mark(new)
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    if mark[0]:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
