"""Work that resumes: keyed anti-joins in batch, checkpoints in Structured Streaming, and the event funnel."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.operators.joining import remaining


def resume(plan: DataFrame, done: DataFrame, key: str, order: str, limit: int | None = None) -> DataFrame:
    """What is left to do, in plan order, `limit` rows at the most."""
    left = remaining(plan, done, key).orderBy(order)
    return left if limit is None else left.limit(limit)


def process_new(spark: SparkSession, source: str, schema, key: str, work: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> None:
    """Read what came since the last run, drop keys that are done, work on the rest and append it.

    The checkpoint knows the files that were read; the anti-join makes a repeated batch harmless.
    """

    def batch(rows: DataFrame, _: int) -> None:
        new = rows.dropDuplicates([key])
        try:
            new = remaining(new, spark.read.parquet(sink), key)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        work(new).write.mode("append").parquet(sink)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def funnel(events: DataFrame, steps: list[str], user: str = "user_id", kind: str = "event_type", at: str = "ts") -> DataFrame:
    """(step, users, reached): users with the step at all, and after all steps before it."""
    first = events.where(F.col(kind).isin(steps)).groupBy(user).agg(*[F.min(F.when(F.col(kind) == s, F.col(at))).alias(f"s{i}") for i, s in enumerate(steps)])
    reached, cells = F.lit(True), []
    for i, s in enumerate(steps):
        reached = reached & F.col(f"s{i}").isNotNull()
        if i:
            reached = reached & (F.col(f"s{i}") >= F.col(f"s{i - 1}"))
        cells.append(F.struct(F.lit(i).alias("n"), F.lit(s).alias("step"), F.col(f"s{i}").isNotNull().alias("u"), F.coalesce(reached, F.lit(False)).alias("r")))
    rows = first.select(F.explode(F.array(*cells)).alias("c"))
    return rows.groupBy("c.n", "c.step").agg(F.sum(F.col("c.u").cast("long")).alias("users"), F.sum(F.col("c.r").cast("long")).alias("reached"))


def wasted(events: DataFrame, start: str, done: str, user: str = "user_id", kind: str = "event_type") -> DataFrame:
    """Users that started but never finished."""
    started = events.where(F.col(kind) == start).select(user).distinct()
    return started.join(events.where(F.col(kind) == done).select(user), user, "left_anti")


def windowed_counts(stream: DataFrame, size: str, late: str, at: str = "ts", kind: str = "event_type") -> DataFrame:
    """Counts per event-time window and kind, batch or streaming, with late rows up to `late`."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, size).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
