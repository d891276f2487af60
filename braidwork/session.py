"""Session defaults for local use; on a cluster the submitter's settings hold."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "braidwork", cpus: int | None = None, shuffle: int = 8) -> SparkSession:
    """A local session with adaptive execution; `cpus` defaults to all of them."""
    return (
        SparkSession.builder.master(f"local[{cpus or os.cpu_count()}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BRAIDWORK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def spread(df: DataFrame, source: DataFrame | None = None, least: int = 64 << 20) -> DataFrame:
    """Rows dealt over all cores where `source` (`df` if None) is under `least` bytes a core, else `df` as it is.

    One small file is one task, however long its rows take; large inputs fill the cores and aren't shuffled for it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str((source or df)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < least * cores else df


def dealt(df: DataFrame, key: str, rounds: int = 4) -> DataFrame:
    """Rows dealt by a key over so many tasks a core at least, for costly per-row work behind an aggregation.

    Adaptive execution sizes its tasks by bytes: 8 of them on 6 cores take as long as 12.
    """
    spark = df.sparkSession
    return df.repartition(max(rounds * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per application.

    Workers that were started elsewhere than in the repository then find it, without a shared folder.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="braidwork-")).resolve() / f"{here.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)
