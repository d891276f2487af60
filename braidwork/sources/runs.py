"""Experiment settings, the record of a run, and checks that files exist."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """The defaults of an experiment."""

    voices: tuple[str, ...] = ()
    speeds: tuple[float, ...] = (1.0,)
    sample_rate: int = 24_000
    max_chars: int = 250
    min_s: float = 3.0
    max_s: float = 30.0
    dnsmos_min: float | None = None
    max_synth_frac: float = 0.5
    split_seed: int = 20260617
    cs_threshold: float = 0.4
    tau_recall: float = 0.80
    tau_cer: float = 0.30

    def checked(self, known: tuple[str, ...]) -> Settings:
        """Itself, with speeds as floats; unknown voices and speeds outside 0.5 to 2 are errors."""
        if odd := sorted({*self.voices} - {*known}):
            raise ValueError(f"unknown voices {odd}")
        speeds = tuple(map(float, self.speeds))
        if odd := [s for s in speeds if not 0.5 <= s <= 2]:
            raise ValueError(f"speeds out of range {odd}")
        return replace(self, speeds=speeds, voices=tuple(self.voices))

    def calibrated(self, report: dict) -> Settings:
        """With the thresholds that a calibration report has."""
        return replace(self, **{k: report[k] for k in ("tau_recall", "tau_cer") if k in report})


def load_settings(path: str, known: tuple[str, ...], report: str | None = None) -> Settings:
    """Settings of a JSON file, defaults where it has none, thresholds of a calibration report if there is one.

    A report that can't be read is passed over. Fields that aren't settings are left to their readers.
    """
    held = json.loads(Path(path).read_text(encoding="utf-8"))
    names = {f.name for f in fields(Settings)}
    own = {k: tuple(v) if isinstance(v, list) else v for k, v in held.items() if k in names}
    settings = Settings(**({"voices": tuple(known)} | own)).checked(known)
    if report is not None and Path(report).exists():
        try:
            settings = settings.calibrated(json.loads(Path(report).read_text(encoding="utf-8")))
        except ValueError:
            pass
    return settings


def stamp(spark: SparkSession, run_id: str, settings: Settings, inputs: dict[str, str]) -> DataFrame:
    """One row per input (name, path, sha256; null if missing), with the run and its settings' hash."""
    text = json.dumps(asdict(settings), sort_keys=True, ensure_ascii=False)
    rows = [(run_id, hashlib.sha256(text.encode()).hexdigest(), n, p) for n, p in inputs.items()]
    named = spark.createDataFrame(rows, "run_id string, config_sha256 string, name string, path string")
    hashes = None
    for path in inputs.values():
        try:
            one = spark.read.format("binaryFile").load(path).select(F.lit(path).alias("path"), F.sha2("content", 256).alias("sha256"))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        hashes = one if hashes is None else hashes.unionByName(one)
    return named.withColumn("sha256", F.lit(None).cast("string")) if hashes is None else named.join(hashes.distinct(), "path", "left")


def with_file(df: DataFrame, path_column: str, folder: str) -> DataFrame:
    """Rows whose path names a file under `folder`; the listing is joined, contents aren't read."""
    plain = lambda c: F.regexp_replace(c, r"^[a-z0-9]+:/+", "/")
    listed = df.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(plain("path").alias("__p"))
    return df.join(listed, plain(F.col(path_column)) == F.col("__p"), "left_semi")


def ranked_words(spark: SparkSession, path: str, most: int = 40_001) -> DataFrame:
    """(word): first fields of the first `most` lines of a ranked list, lower case, of two letters or more, each once."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    words = lines.where(F.col("at") < most).select(F.lower(F.split_part("line", F.lit(" "), F.lit(1))).alias("word"))
    return words.select(F.trim("word").alias("word")).where(F.col("word").rlike(r"^\p{L}{2,}$")).distinct()
