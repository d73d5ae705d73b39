"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct n-grams of 4, 6 and 8 bytes (UTF-8, A-Z lowered, other ASCII than letters and digits as
one space) of the whole text, hashed to ``BUCKETS``. Each is scaled by its log-count ratio, log of its smoothed
share in toxic over that in other texts; ratios below ``LEAST_RATIO`` count as none. A logistic regression is fitted
on the scaled features, over the fourth root of their number: long texts have more of them, but not more meaning. Fitted on labelled documents outside the held-out fifth, at most
2 * ``FIT_DOCS`` of them, drawn by hash: all of a class up to its bound, a third of ``FIT_DOCS`` for the toxic. The
intercept is then set to the share of toxic among all labelled documents outside the fifth, so scores mean the same
whatever part of each class was drawn. Scoring uses nothing but the text.

Defined results: null and empty texts have no features, so the intercept scores them. Several labels of one
document: toxic if any is. Without labelled rows every score is 0.4 (not toxic); with labels of one
class only, the smoothed share. Repeated rows get equal scores; a null id is not held out and is never learned from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from serupa.llm.batches import map_text
from serupa.llm.sampling import bounded_sample

BUCKETS_LOG2 = 20
BUCKETS = 1 << BUCKETS_LOG2
GRAMS = (4, 6, 8)
FIT_DOCS = 3000
SMOOTHING = 1.0
LEAST_RATIO = 1.0
PIECE = 1 << 20  # bytes of a text hashed, or features of a fit added up, at once
FETCHES = 16  # pieces in which the sample's features come to the driver
_PLAIN = bytes(c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256))
_FACTOR = np.uint32(2654435761)


def fold(key: str) -> Column:
    """crc32 of the id as text, modulo 5; rows of 0 are held out. Null for a null id."""
    return F.crc32(F.col(key).cast("string")) % 5


def held_out(key: str) -> Column:
    return F.coalesce(fold(key) == 0, F.lit(False))


class Features:
    """Distinct buckets of one text after another, in no particular order.

    ``last`` keeps, of each bucket, the last place in the text that fell there; a bucket is taken at that place only.
    """

    def __init__(self) -> None:
        self.last = np.zeros(BUCKETS, np.int32)

    def __call__(self, text: bytes | None) -> np.ndarray:
        codes = np.frombuffer(b" %s " % b" ".join((text or b"").lower().translate(_PLAIN).split()), np.uint8)
        found = [np.zeros(0, np.int32)]
        for at in range(0, max(0, len(codes) - min(GRAMS) + 1), PIECE):
            found.append(self._piece(codes[at : at + PIECE + max(GRAMS) - 1].astype(np.uint32) + np.uint32(1)))
        return found[-1] if len(found) <= 2 else np.unique(np.concatenate(found))

    def _piece(self, part: np.ndarray) -> np.ndarray:
        hashes, h = [], part
        for n in range(2, min(max(GRAMS), len(part)) + 1):
            h = (h[:-1] * _FACTOR) ^ part[n - 1 :]
            if n in GRAMS:
                hashes.append((h * _FACTOR) >> np.uint32(32 - BUCKETS_LOG2))
        at = np.concatenate(hashes).astype(np.intp)
        place = np.arange(len(at), dtype=np.int32)
        self.last[at] = place
        return at[self.last[at] == place].astype(np.int32)


@dataclass
class Model:
    weights: np.ndarray  # of each bucket, ratio included
    intercept: float

    def score(self, features: np.ndarray) -> float:
        z = self.intercept + float(self.weights[features].sum()) / max(len(features), 1) ** 0.25
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(texts: list[np.ndarray], toxic: np.ndarray, steps: int = 200, decay: float = 1e-4, offset: float = 0.0) -> Model:
    """Ratios, logistic regression by accelerated gradient descent, calibration.

    ``offset``: log-odds of toxic in all labelled documents, less those in the sample.
    """
    y = np.asarray(toxic, np.float64)
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.4
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    unit = np.maximum([len(t) for t in texts], 1) ** -0.25
    counts = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    for features, v in zip(texts, y, strict=True):
        counts[int(v == 0)][features] += 1  # a text has each of its features once
    shares = [(c + SMOOTHING) / (c + SMOOTHING).sum() for c in counts]
    ratio = np.log(shares[0] / shares[1])
    ratio[(sum(counts) < 2) | (np.abs(ratio) < LEAST_RATIO)] = 0  # what one text alone has tells nothing
    kept = [t[ratio[t] != 0] for t in texts]
    full = np.flatnonzero([len(t) for t in kept])
    parts = [(some, np.array([len(kept[i]) for i in some])) for some in _parts(full, kept)]
    index = [np.concatenate([kept[i] for i in some]) for some, _ in parts]
    del kept

    def project(w):
        z = np.zeros(len(y))
        for (some, sizes), at in zip(parts, index, strict=True):
            z[some] = np.add.reduceat(w[at], np.cumsum(sizes) - sizes)
        return z * unit

    def gradient(gap):
        total = np.zeros(BUCKETS)
        for (some, sizes), at in zip(parts, index, strict=True):
            total += np.bincount(at, np.repeat((gap * unit)[some], sizes), minlength=BUCKETS)
        return total

    rate = 4 / max((project(ratio**2) * unit).max(), 1e-9)  # of the curvature's bound, the longest scaled text
    w = last = np.zeros(BUCKETS)
    b = last_b = float(np.log(y.mean() / (1 - y.mean())))
    for step in range(steps):
        ahead = step / (step + 3)
        v, c = w + ahead * (w - last), b + ahead * (b - last_b)
        gap = 1 / (1 + np.exp(-np.clip(project(v * ratio) + c, -30, 30))) - y
        last, last_b = w, b
        w = v - rate * (ratio * gradient(gap) / len(y) + decay * v)
        b = c - gap.mean()
    scale, shift = calibrate(project(w * ratio), y)
    return Model(w * ratio * scale, shift + offset)


def _parts(full: np.ndarray, kept: list[np.ndarray]) -> list[np.ndarray]:
    """Numbers of texts that have features, cut after about ``PIECE`` features each, which bounds the memory of a step."""
    at = np.cumsum([len(kept[i]) for i in full], dtype=np.int64) // PIECE
    return [some for some in np.split(full, np.flatnonzero(np.diff(at)) + 1) if len(some)]


def calibrate(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Scale and shift that make z the log-odds of y: Newton's method on smoothed targets (Platt)."""
    n = y.sum()
    goal = np.where(y > 0, (n + 1) / (n + 2), 1 / (len(y) - n + 2))
    spread = max(z.std(), 1e-12)
    x = np.stack([(z - z.mean()) / spread, np.ones(len(z))], 1)
    theta = np.array([1.0, np.log(y.mean() / (1 - y.mean()))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (goal - p))
        theta += np.clip(step, -1, 1)
    return float(theta[0] / spread), float(theta[1] - theta[0] * z.mean() / spread)


def _features():
    features = Features()
    return lambda texts: [pa.array([features(t).tobytes() for t in texts], pa.binary())]


def fit_model(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", fit_docs: int = FIT_DOCS) -> Model:
    known = labels.where(F.col(label).isNotNull() & (fold(key) != 0)).groupBy(key).agg(F.max(label).cast("int").alias("__toxic"))
    toxic = F.col("__toxic") == 1
    drawn = bounded_sample(known.where(toxic), fit_docs // 3, key).unionByName(bounded_sample(known.where(~toxic), fit_docs - fit_docs // 3, key))
    size = lambda rows: {r["__toxic"]: r["count"] for r in rows.groupBy("__toxic").count().collect()}
    total, part = size(known), size(drawn)
    offset = float(np.log(total[1] / part[1]) - np.log(total[0] / part[0])) if len(part) == 2 else 0.0
    # At most 2 * fit_docs narrow rows, so they may be broadcast.
    rows = docs.select(key, F.col(text).cast("string").alias("text")).join(F.broadcast(drawn), key).limit(2 * fit_docs)
    found = map_text(rows.repartition(FETCHES, key), "features binary", _features, ["__toxic", key])
    drawn = sorted(found.toLocalIterator(), key=lambda row: (row[key], row["features"]))  # one piece in the JVM at a time
    texts, toxic = [np.frombuffer(row["features"], np.int32) for row in drawn], [row["__toxic"] for row in drawn]
    return fit(texts, np.array(toxic), offset=offset)


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with score (0 to 1) and predicted (1 from 0.5 on)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        features, known = Features(), shared.value
        return lambda texts: [pa.array([known.score(features(t)) for t in texts], pa.float64())]

    return map_text(docs, "score double", work, keep, text).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    model = fit_model(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return score(docs, model, ["doc_id"]).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
