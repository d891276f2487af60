"""Tables that cut lineage, written where all executors can read them.

The folder is the one that the session names in spark.checkpoint.dir. Where that is unset, a session whose executors are
this machine's own (tests, a laptop) gets a temporary folder; any other is refused.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from braidwork.operators.ranking import require_local

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    require_local(spark)
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="braidwork-")
        spark.conf.set("spark.checkpoint.dir", f"file://{_OWN[app]}")
    return f"file://{_OWN[app]}"


class Scratch:
    """Intermediate tables of one operator call.

    `keep` writes a DataFrame as Parquet and reads it back: a lost executor costs a re-read,
    not the whole lineage. `drop` removes a table that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self._n}"
        self._n += 1
        df.write.mode("overwrite").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(back)] = path
        return back

    def drop(self, df: DataFrame) -> None:
        path = self._paths.pop(id(df), None)
        if path:
            jvm = self.spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Bound the bytes of Arrow batches to and from Python, so that long texts don't fill a worker.

    A session that has set a smaller bound keeps it.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name).lower().strip()
    unit = {"k": 10, "m": 20, "g": 30}.get(held.rstrip("b")[-1:], 0)
    digits = "".join(c for c in held if c.isdigit())
    if not digits or int(digits) << unit > most:
        spark.conf.set(name, f"{most}b")
