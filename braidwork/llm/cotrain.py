"""Quality classifier by co-training.

Two views of a document: its text content (hashed byte trigrams, shares of kinds of characters) and its page metadata
(language, source, size, and the page's make-up: word and line lengths, repetition of words and lines; no characters).
Each view has a ridge logistic model, calibrated on held-out labelled rows. In every round both models score all
documents outside the sample, and each view hands its most confident documents to the other as pseudo-labels: by rank and per class,
so that both views give and both classes are given. A pseudo-label is the giver's calibrated chance, so that a weak view
misleads less. Pseudo-labels of a round replace those of the round before, and
their number grows with the rounds. The calibrated views are then combined by a model fitted on the held-out rows.

What reaches the driver is bounded by `Plan`: features of `labelled` rows and of 4 * `per_round` * `rounds` pseudo-labelled
ones, in rows, not in ids. Scoring is distributed and covers every document in every round.

Defined results. Null, empty or blank text: score 0, not kept. Null language or source: a value of
its own. Ids are integers; a null id is scored, but not learnt from; a document with several labels has the least; labels of unknown documents
are ignored. Of rows with one id and one text, and of equal texts in the choice of pseudo-labels, one is learnt from.
Without labels of both classes every score is 0.5 and nothing with words is rejected. Ties in rank are broken by id
and a tag of the text. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm.columns import text_tag
from braidwork.llm.grouped import released
from braidwork.llm.scratch import Scratch, small_batches

TRIGRAMS, SHAPES = 1024, 8
SOURCES, LANGS, BINS = 64, 16, 24
PAGE = 6  # measures of the page, each in one of BINS bins
TEXT_DIMS, META_DIMS = TRIGRAMS + SHAPES + 1, SOURCES + LANGS + PAGE * BINS + 1


@dataclass(frozen=True)
class Plan:
    """Bounds of what is learnt from and the course of training."""

    labelled: int = 5000
    rounds: int = 3
    per_round: int = 300
    held_out: float = 0.25
    cut: float = 0.5


def text_features(data: bytes) -> np.ndarray:
    """Square roots of the shares of hashed trigrams, shape measures and a constant."""
    out = np.zeros(TEXT_DIMS, np.float32)
    out[-1] = 1
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return out
    counts = np.zeros(TRIGRAMS)
    if len(a) > 2:
        wide = a.astype(np.uint32)
        code = (wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) * np.uint32(2654435761) >> np.uint32(22)
        counts = np.bincount(code, minlength=TRIGRAMS)
        out[:TRIGRAMS] = np.sqrt(counts / len(code)) * 8
    byte = np.bincount(a, minlength=256) / len(a)
    upper, digit = byte[65:91].sum(), byte[48:58].sum()
    lower, space = byte[97:123].sum(), byte[[9, 10, 11, 12, 13, 32]].sum()
    marks = byte[33:127].sum() - upper - digit - lower
    share = counts[counts > 0] / max(1, counts.sum())
    entropy = -(share * np.log2(share)).sum() if len(share) else 0.0
    out[TRIGRAMS : TRIGRAMS + SHAPES] = (4 * upper, 4 * marks, 4 * digit, 2 * space, entropy / 5, 4 * (share**2).sum(), np.log1p(len(a)) / 10, len(share) / min(TRIGRAMS, len(a)))
    return out


def page_bins(raw: bytes) -> tuple[int, ...]:
    """Bins of size, bytes a word, longest word, words a line, repetition of words and of lines."""
    words, lines = raw.split(), raw.split(b"\n")
    n = max(1, len(words))
    measures = (
        len(raw).bit_length(), 3 * (len(raw) / n - 2), 3 * math.log2(max(map(len, words), default=1)), 2 * math.log2(1 + n / len(lines)),
        4 * math.log2(n / max(1, len(set(words)))), 6 * math.log2(len(lines) / len(set(lines))),
    )
    return tuple(min(BINS - 1, max(0, int(x))) for x in measures)


def meta_features(lang: str | None, source: str | None, raw: bytes) -> np.ndarray:
    """One-hot places of language, source and the page's bins, and a constant."""
    out = np.zeros(META_DIMS, np.float32)
    out[zlib.crc32(b"s" + source.encode() if source is not None else b"") % SOURCES] = 1
    out[SOURCES + zlib.crc32(b"l" + lang.encode() if lang is not None else b"") % LANGS] = 1
    for i, x in enumerate(page_bins(raw)):
        out[SOURCES + LANGS + i * BINS + x] = 1
    out[-1] = 1
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 200) -> np.ndarray:
    """Weights of a ridge logistic model, by accelerated gradient steps; classes count alike."""
    weight = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum()))
    rate = 1 / (0.25 * (weight * np.einsum("ij,ij->i", x, x)).sum() + ridge)
    w = ahead = np.zeros(x.shape[1])
    for i in range(steps):  # products in the features' own precision: no copy of them is made
        error = weight * (_sigmoid(x @ ahead.astype(x.dtype)) - y)
        slope = x.T @ error.astype(x.dtype) + ridge * ahead
        new = ahead - rate * slope
        ahead = new + i / (i + 3) * (new - w)
        w = new
    return w


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of Platt's scaling, by Newton steps on smoothed targets."""
    pos, neg = (y > 0.5).sum(), (y <= 0.5).sum()
    target = np.where(y > 0.5, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([z, np.ones(len(z))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = _sigmoid(x @ w)
        slope = x.T @ (p - target) + 1e-3 * w
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), slope)
    return float(w[0]), float(w[1])


@dataclass
class Model:
    """Weights of both views, their calibrations, the model that combines them, and the course of training.

    `handed` has (round, receiving view, label, documents): view 0 is the text, view 1 the metadata.
    """

    text: np.ndarray
    meta: np.ndarray
    text_scale: tuple[float, float]
    meta_scale: tuple[float, float]
    both: np.ndarray
    handed: list[tuple[int, int, int, int]] = field(default_factory=list)

    def views(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated log-odds of both views."""
        return text @ self.text * self.text_scale[0] + self.text_scale[1], meta @ self.meta * self.meta_scale[0] + self.meta_scale[1]

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, m = self.views(text, meta)
        return _sigmoid(t), _sigmoid(m), _sigmoid(np.stack([t, m, np.ones(len(t))], 1) @ self.both)


@dataclass
class Sample:
    """Features and labels (0 or 1) of the labelled rows, parted once into a training and a held-out part."""

    text: np.ndarray
    meta: np.ndarray
    labels: np.ndarray
    held: np.ndarray
    train: np.ndarray

    @classmethod
    def parted(cls, text: np.ndarray, meta: np.ndarray, labels: np.ndarray, held_out: float) -> Sample | None:
        """None if a class is missing or there are hardly any rows."""
        if len(labels) < 10 or len(set(labels.tolist())) < 2:
            return None
        spot = np.arange(len(labels)) % max(2, round(1 / held_out)) == 0
        held, train = np.flatnonzero(spot), np.flatnonzero(~spot)
        if len(set(labels[held].tolist())) < 2 or len(set(labels[train].tolist())) < 2:
            held = train = np.arange(len(labels))
        return cls(text, meta, labels, held, train)

    def fitted(self, given: tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None) -> Model:
        """The model; `given` has for each view the features and labels that the other one handed it."""
        found = []
        for v, own in enumerate((self.text, self.meta)):
            x, y = own[self.train], self.labels[self.train].astype(float)
            if given is not None and len(given[v][1]):
                x, y = np.concatenate([x, given[v][0]]), np.concatenate([y, given[v][1]])
            w = fit(x, y)
            found.append((w, _calibrate(own[self.held] @ w, self.labels[self.held])))
        (wt, st), (wm, sm) = found
        z = np.stack([self.text[self.held] @ wt * st[0] + st[1], self.meta[self.held] @ wm * sm[0] + sm[1], np.ones(len(self.held))], 1)
        start = both = np.array([0.5, 0.5, 0.0])
        y = self.labels[self.held]
        for _ in range(30):  # Newton, drawn towards the mean of both views
            p = _sigmoid(z @ both)
            slope = z.T @ (p - y) + (both - start)
            both = both - np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.eye(3), slope)
        return Model(wt, wm, st, sm, both)


def _rows_to_features(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Raw texts and both views of rows (_, text, lang, source)."""
    raw = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in batch.column(1)]
    text = np.stack([text_features(x) for x in raw])
    meta = np.stack([meta_features(a.as_py(), b.as_py(), x) for a, b, x in zip(batch.column(2), batch.column(3), raw, strict=True)])
    return raw, text, meta


def _features(rows: DataFrame) -> DataFrame:
    """Rows (key, text, lang, source) to (key, text, meta): feature vectors as bytes."""

    @released
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                _, text, meta = _rows_to_features(part)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in text], pa.binary()), pa.array([x.tobytes() for x in meta], pa.binary())], names=["key", "text", "meta"])

    return rows.mapInArrow(made, f"key {rows.dtypes[0][1]}, text binary, meta binary")


def _collected(docs: DataFrame, wanted: DataFrame, most: int) -> tuple[list, np.ndarray, np.ndarray]:
    """Extra values and features of the documents that `wanted` names by (_i, _t, more), one row for each of these.

    `wanted` has at most `most` rows; rows of the documents that share id and text count once.
    """
    same = (F.col("_id") == F.col("_i")) & (F.col("_tag") == F.col("_t"))
    met = docs.join(F.broadcast(wanted.limit(most)), same).groupBy("_i", "_t", "more").agg(F.min_by(F.struct("_text", "_lang", "_source"), F.struct("_lang", "_source")).alias("_row"))
    rows = met.select(F.struct("_i", "_t", "more").alias("key"), "_row._text", "_row._lang", "_row._source")
    got = sorted(_features(rows).limit(most).collect(), key=lambda r: (r["key"]["_i"], r["key"]["_t"], r["key"]["more"]))
    if not got:
        return [], np.zeros((0, TEXT_DIMS), np.float32), np.zeros((0, META_DIMS), np.float32)
    view = lambda name, dims: np.frombuffer(b"".join(r[name] for r in got), np.float32).reshape(-1, dims)
    return [r["key"]["more"] for r in got], view("text", TEXT_DIMS), view("meta", META_DIMS)


def _log_odds(docs: DataFrame, model: Model) -> DataFrame:
    """(_id, _tag, t, m) of documents that have words: calibrated log-odds of both views."""

    @released
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw, text, meta = _rows_to_features(part)
                t, m = model.views(text, meta)
                out = pa.RecordBatch.from_arrays([part.column(0), part.column(4), pa.array(t, pa.float64()), pa.array(m, pa.float64())], names=["_id", "_tag", "t", "m"])
                yield out.filter(pa.array([bool(x.strip()) for x in raw], pa.bool_()))

    return docs.select("_id", "_text", "_lang", "_source", "_tag").mapInArrow(scored, "_id long, _tag long, t double, m double")


def _confident(odds: DataFrame, many: dict[int, int]) -> DataFrame:
    """(_i, _t, more) of the surest rows by either view and for either label; `more` is (2 * receiving view + label, log-odds of the giver)."""
    picks = []
    for receiver, column in ((1, "t"), (0, "m")):
        for label in (0, 1):
            order = F.desc(column) if label else F.asc(column)
            picks.append(odds.orderBy(order, "_id", "_tag").limit(many[label]).select(F.col("_id").alias("_i"), F.col("_tag").alias("_t"), F.struct(F.lit(2 * receiver + label).alias("code"), F.col(column).alias("odds")).alias("more")))
    return functools.reduce(DataFrame.unionByName, picks)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", label_col: str = "quality", plan: Plan = Plan()) -> Model | None:
    """The model, from a bounded sample of labelled documents and pseudo-labels among all others."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "cotrain")
    own = docs.select(F.col(id_col).cast("long").alias("_id"), text_tag(text_col).alias("_tag"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source")).where("_id is not null")
    marked = labels.select(F.col(id_col).cast("long").alias("_l"), F.col(label_col).cast("int").alias("_label")).where("_l is not null and _label is not null").groupBy("_l").agg(F.least(F.lit(1), F.min("_label")).alias("more"))
    by_hash = F.xxhash64(F.lit(41), "_i", "_t")
    known = own.select(F.col("_id").alias("_i"), F.col("_tag").alias("_t")).distinct().join(marked, F.col("_i") == F.col("_l")).select("_i", "_t", "more")
    sample = scratch.keep(known.orderBy(by_hash, "_i", "_t").limit(plan.labelled))
    found, text, meta = _collected(own, sample, plan.labelled)
    held = Sample.parted(text, meta, np.array(found), plan.held_out)
    if held is None:
        return None
    open_ = own.join(F.broadcast(sample.select("_i").distinct()), F.col("_id") == F.col("_i"), "left_anti")  # `labelled` ids at most
    model, handed, rate = held.fitted(), [], float(held.labels.mean())
    for k in range(1, plan.rounds + 1):
        odds = scratch.keep(_log_odds(open_, model).groupBy("_tag").agg(F.min(F.struct("_id", "t", "m")).alias("_x")).select("_x._id", "_tag", "_x.t", "_x.m"))
        n = odds.count()
        # half of what a class's rate lets expect, at most: no document can be surest of both
        many = {c: min(plan.per_round * k, int(n * r / 2)) for c, r in ((0, 1 - rate), (1, rate))}
        picks, text, meta = _collected(open_, _confident(odds, many), 4 * plan.per_round * plan.rounds)
        scratch.drop(odds)
        codes, chances = np.array([x["code"] for x in picks], np.int64), _sigmoid(np.array([x["odds"] for x in picks]))
        handed += [(k, v, c, int((codes == 2 * v + c).sum())) for v in (0, 1) for c in (0, 1)]
        given = tuple((x[codes // 2 == v], chances[codes // 2 == v]) for v, x in ((0, text), (1, meta)))
        model = held.fitted(given)
    model.handed = handed
    return model


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cut: float = 0.5) -> DataFrame:
    """One row per document: both views' calibrated scores, the combined one, and whether it is kept."""
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    @released
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            out = np.full((3, n), 0.5)
            blank = np.zeros(n, bool)
            for at in range(0, n, 256):
                part = batch.slice(at, 256)
                if model is not None:
                    raw, text, meta = _rows_to_features(part)
                    out[:, at : at + len(raw)] = model.scores(text, meta)
                else:
                    raw = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in part.column(1)]
                blank[at : at + len(raw)] = [not x.strip() for x in raw]
            out[:, blank] = 0
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in out), pa.array((out[2] >= cut) & ~blank)], names=[id_col, "text_score", "meta_score", "score", "kept"])

    return docs.select(id_col, text_col, lang_col, source_col).mapInArrow(scored, f"{id_col} {kind}, text_score double, meta_score double, score double, kept boolean")


def classify(docs: DataFrame, labels: DataFrame, plan: Plan = Plan(), **columns: str) -> DataFrame:
    """Train on the labelled sample and score all documents."""
    model = train(docs, labels, plan=plan, **columns)
    columns.pop("label_col", None)
    return score(docs, model, cut=plan.cut, **columns)
