"""16-bit mono waves: headers, silence, trimming, joining, and frame energy."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATE = 24_000


def header(data: bytes) -> tuple[float | None, int | None]:
    """Seconds and rate, or nothing if it can't be read."""
    try:
        with wave.open(io.BytesIO(data)) as w:
            return w.getnframes() / w.getframerate(), w.getframerate()
    except (wave.Error, EOFError):
        return None, None


def encode(samples: np.ndarray, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def decode(data: bytes) -> tuple[np.ndarray, int]:
    with wave.open(io.BytesIO(data)) as w:
        return np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32) / 32767, w.getframerate()


def silent(seconds: float, rate: int = RATE) -> bytes:
    return encode(np.zeros(round(seconds * rate)), rate)


def trimmed(x: np.ndarray, rate: int, least: float = 0.01, pad_ms: float = 30) -> np.ndarray:
    """Without silent ends, but for a pad; of silence alone, 20 ms."""
    loud = np.flatnonzero(np.abs(x) >= least)
    if not len(loud):
        return x[: min(len(x), round(rate * 0.02))]
    pad = round(pad_ms / 1000 * rate)
    return x[max(0, loud[0] - pad) : loud[-1] + 1 + pad]


def joined(clips: list[np.ndarray], rate: int, gap_ms: float = 90, fade_ms: float = 4, trim: bool = True) -> np.ndarray:
    """Clips after one another with a pause and an equal-power fade where they meet."""
    parts = [trimmed(c, rate) if trim else c for c in clips if len(c)]
    if not parts:
        return np.zeros(0, np.float32)
    gap, fade = round(gap_ms / 1000 * rate), round(fade_ms / 1000 * rate)
    out = np.zeros(max(0, sum(map(len, parts)) + (gap - fade) * (len(parts) - 1)), np.float32)
    out[: len(parts[0])] = parts[0]
    at = len(parts[0])
    for p in parts[1:]:
        start = at - fade + gap
        n = min(fade, len(p))
        angle = np.pi / 2 * np.arange(1, n + 1) / (fade + 1)
        inside = (start + np.arange(n) >= 0) & (start + np.arange(n) < len(out))
        here = (start + np.arange(n))[inside]
        out[here] = (out[here] * np.cos(angle)[: n][inside]) + (p[:n] * np.sin(angle))[inside]
        out[start + fade : start + fade + len(p) - n] = p[n:]
        at = start + fade + len(p) - n
    return out[: min(at, len(out))]


def _decibels(x: np.ndarray, frame: int = 1024, hop: int = 256) -> np.ndarray:
    """Frame energy against the peak, frames centred on padded ends."""
    wide = np.pad(x / (np.abs(x).max(initial=0) + 1e-9), frame // 2)
    frames = np.lib.stride_tricks.sliding_window_view(wide, frame)[::hop]
    return 20 * np.log10(np.sqrt((frames**2).mean(1)) + 1e-7)


def energy_range(x: np.ndarray) -> float:
    """Decibels from the 5th to the 95th percentile of frames within 40 dB of the loudest."""
    db = _decibels(np.asarray(x, float))
    voiced = db[db > db.max() - 40]
    return float(np.percentile(voiced, 95) - np.percentile(voiced, 5)) if len(voiced) >= 5 else 0.0


def silence_share(x: np.ndarray) -> float:
    return float((_decibels(np.asarray(x, float)) < -40).mean())


def read_waves(spark: SparkSession, glob: str) -> DataFrame:
    """(utt_id, path, duration_s, rate, sha256) of wave files; nulls where a header can't be read."""

    @F.pandas_udf("struct<duration_s: double, rate: int>")
    def meta(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([header(c) for c in content], columns=["duration_s", "rate"]).astype({"rate": "Int32"})

    files = spark.read.format("binaryFile").load(glob)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return files.select(stem.alias("utt_id"), "path", meta("content").alias("m"), F.sha2("content", 256).alias("sha256")).select("utt_id", "path", "m.*", "sha256")
