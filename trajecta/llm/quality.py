"""Document quality by Bradley-Terry ranking: logistic loss on feature differences of preference pairs.

Features come from the whole text alone. Pairs are a better and a worse labelled document; the weights
make the better one's score the larger. A score is the logistic of its distance from the quantile of the
training scores that parts as many documents as are labelled bad.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, documents, hashed_sample, saved

#: Labelled rows that a model is fitted on at most, and preference pairs made of them.
SAMPLE, PAIRS = 20_000, 200_000
#: One of so many remainders of crc32(doc_id as text) is held out from training.
FOLDS, HELD_OUT = 3, 1

_UPPER = np.zeros(256); _UPPER[65:91] = 1  # noqa: E702
_LOWER = np.zeros(256); _LOWER[97:123] = 1  # noqa: E702
_DIGIT = np.zeros(256); _DIGIT[48:58] = 1  # noqa: E702
_HIGH = np.zeros(256); _HIGH[128:] = 1  # noqa: E702
_STOP = np.zeros(256); _STOP[[33, 46, 63]] = 1  # noqa: E702
_MARK = np.zeros(256); _MARK[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"()-"]] = 1  # noqa: E702
_CLASSES = np.stack([_UPPER, _LOWER, _DIGIT, _HIGH, _STOP, _MARK])
_BANG = 33
N_FEATURES = 20


def features(text: str | None) -> list[float]:
    """Numbers about a whole text; null counts as empty. All are finite."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n, k = len(raw), len(words)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = (_CLASSES @ count) / max(n, 1)
    lines = raw.split(b"\n")
    seen = Counter(words)
    distinct = len(seen)
    top = max(seen.values(), default=0)
    sizes = np.fromiter(map(len, words), np.int64, k)
    pairs = len(set(zip(words, words[1:])))
    ended = sum(not 97 <= w[-1] <= 122 for w in words)
    caps = sum(w.isupper() for w in words)
    return [
        1.0, math.log1p(n), math.log1p(k), *shares.tolist(), count[_BANG] / max(k, 1),
        float(sizes.mean()) / 10 if k else 0.0, float(sizes.std()) / 10 if k else 0.0, min(float(sizes.max()), 100.0) / 100 if k else 0.0,
        distinct / max(k, 1), math.log1p(distinct) / math.log1p(max(k, 1)), top / max(k, 1), pairs / max(k - 1, 1),
        len(set(lines)) / len(lines), ended / max(k, 1), caps / max(k, 1),
    ]


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and features (array<double>) of every row."""

    def rows(given: Iterator[tuple]):
        for doc_id, value in given:
            yield doc_id, features(value)

    return arrow_map(docs, ["doc_id", text], "doc_id long, features array<double>", rows, flush=5_000)


@dataclass(frozen=True)
class Model:
    weights: tuple[float, ...]
    centre: tuple[float, ...]
    spread: tuple[float, ...]
    threshold: float
    slope: float

    def score(self, values: list[float]) -> float:
        raw = sum(w * (v - c) / s for w, v, c, s in zip(self.weights, values, self.centre, self.spread))
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, self.slope * (raw - self.threshold)))))


def fit(values: np.ndarray, good: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> Model:
    """Weights from preference pairs of the given rows; with one class only, all documents score 0.5 or more if it is good, else less."""
    d = values.shape[1] if values.ndim == 2 and len(values) else N_FEATURES
    better, worse = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    if not len(better) or not len(worse):
        return Model((0.0,) * d, (0.0,) * d, (1.0,) * d, 1.0 if len(worse) else -1.0, 1.0)
    centre, spread = values.mean(0), values.std(0)
    spread[spread < 1e-9] = 1.0
    x = (values - centre) / spread
    rng = np.random.default_rng(seed)
    gap = x[rng.choice(better, pairs)] - x[rng.choice(worse, pairs)]
    w, ridge = np.zeros(d), 1e-3
    for _ in range(30):  # Newton steps on mean log(1 + exp(-gap.w)) + ridge
        p = 1 / (1 + np.exp(np.clip(gap @ w, -40, 40)))
        slope = -(gap * p[:, None]).mean(0) + ridge * w
        bend = (gap * (p * (1 - p))[:, None]).T @ gap / pairs + ridge * np.eye(d)
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    raw = x @ w
    threshold = float(np.quantile(raw, len(worse) / (len(worse) + len(better))))
    near = np.sort(raw)
    at = np.searchsorted(near, threshold)
    if 0 < at < len(near):  # between the two scores that the quantile parts
        threshold = float((near[at - 1] + near[at]) / 2)
    return Model(tuple(map(float, w)), tuple(map(float, centre)), tuple(map(float, spread)), threshold, 1.0)


def usable(labels: DataFrame) -> DataFrame:
    """doc_id and quality outside the held-out fold. Labels that are null or contradict each other for a doc_id are left out."""
    told = labels.where(f"quality in (0, 1) and crc32(cast(doc_id as string)) % {FOLDS} <> {HELD_OUT}").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).where("quality = _most")
    return told.select("doc_id", "quality")


def train(scored: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from doc_id with features and labels (doc_id, quality), outside the held-out fold.

    If more than ``sample`` rows are labelled, those with the least hash of doc_id are taken.
    """
    taken = hashed_sample(saved(scored.join(usable(labels), "doc_id")), "doc_id", sample, "features").select("features", "quality").collect()  # at most `sample` rows
    return fit(np.array([r["features"] for r in taken], dtype=float), np.array([r["quality"] for r in taken]))


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of train(), from texts: only those of the sampled labels are turned into features.

    The sample is drawn from the labelled ids that have a document, so at most ``sample`` ids are broadcast.
    """
    told = usable(labels)
    known = saved(told.join(docs.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi"))
    chosen = saved(hashed_sample(known, "doc_id", sample))
    return train(with_features(docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")), chosen, sample)


def score(self, values: list[float]) -> float:
        raw = sum(w * (v - c) / s for w, v, c, s in zip(self.weights, values, self.centre, self.spread))
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, self.slope * (raw - self.threshold)))))


def fit(values: np.ndarray, good: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> Model:
    """Weights from preference pairs of the given rows; with one class only, all documents score 0.5 or more if it is good, else less."""
    d = values.shape[1] if values.ndim == 2 and len(values) else N_FEATURES
    better, worse = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    if not len(better) or not len(worse):
        return Model((0.0,) * d, (0.0,) * d, (1.0,) * d, 1.0 if len(worse) else -1.0, 1.0)
    centre, spread = values.mean(0), values.std(0)
    spread[spread < 1e-9] = 1.0
    x = (values - centre) / spread
    rng = np.random.default_rng(seed)
    gap = x[rng.choice(better, pairs)] - x[rng.choice(worse, pairs)]
    w, ridge = np.zeros(d), 1e-3
    for _ in range(30):  # Newton steps on mean log(1 + exp(-gap.w)) + ridge
        p = 1 / (1 + np.exp(np.clip(gap @ w, -40, 40)))
        slope = -(gap * p[:, None]).mean(0) + ridge * w
        bend = (gap * (p * (1 - p))[:, None]).T @ gap / pairs + ridge * np.eye(d)
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    raw = x @ w
    threshold = float(np.quantile(raw, len(worse) / (len(worse) + len(better))))
    near = np.sort(raw)
    at = np.searchsorted(near, threshold)
    if 0 < at < len(near):  # between the two scores that the quantile parts
        threshold = float((near[at - 1] + near[at]) / 2)
    return Model(tuple(map(float, w)), tuple(map(float, centre)), tuple(map(float, spread)), threshold, 1.0)


def train(scored: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from doc_id with features and labels (doc_id, quality), outside the held-out fold.

    Labels that are null or contradict each other for a doc_id are left out. If more than ``sample`` rows
    are labelled, those with the least hash of doc_id are taken.
    """
    told = labels.where(f"quality in (0, 1) and crc32(cast(doc_id as string)) % {FOLDS} <> {HELD_OUT}").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).where("quality = _most")
    taken = hashed_sample(saved(scored.join(told.select("doc_id", "quality"), "doc_id")), "doc_id", sample, "features").select("features", "quality").collect()  # at most `sample` rows
    return fit(np.array([r["features"] for r in taken], dtype=float), np.array([r["quality"] for r in taken]))


def score(scored: DataFrame, model: Model) -> DataFrame:
    """Adds held_out, score and predicted to doc_id with features; without Python on the executors."""
    scale = [w / s for w, s in zip(model.weights, model.spread)]
    shift = -sum(w * c for w, c in zip(scale, model.centre)) - model.threshold
    raw = sum((F.get("features", F.lit(i)) * F.lit(w) for i, w in enumerate(scale)), F.lit(shift))
    value = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), raw * model.slope))))
    return scored.select("doc_id", F.expr(f"coalesce(crc32(cast(doc_id as string)) % {FOLDS} = {HELD_OUT}, false)").alias("held_out"), value.alias("score")).withColumn("predicted", F.expr("if(score >= 0.5, 1, 0)"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    Null and empty texts are scored from their (zero) features; repeated rows score alike; a null doc_id is
    never held out and never trained on; without usable labels every document is predicted good.
    """
    return score(with_features(docs), trained(docs, labels))


def accept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns; each text is scored where it is read."""
    model = trained(docs, labels)
    columns = docs.columns
    at = columns.index("text")

    def rows(given: Iterator[tuple]):
        for row in given:
            if model.score(features(row[at])) >= 0.5:
                yield row

    return arrow_map(docs, columns, docs.schema, rows, flush=2_000)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
