"""Quality classification by compression.

One raw-content zstandard dictionary is made from texts labelled good, one from texts labelled bad. The
difference of a text's two compressed sizes, normalised by its length, is calibrated to a probability by logistic
regression on labelled texts that aren't in the dictionaries. Nothing else enters the score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, crc_mod, documents, small_batches
from .compression import Sizer, hashed_slice, make_dictionary


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    #: Of the logistic function: intercept and weight of the normalised difference.
    weights: tuple[float, float]
    #: Score of a text without bytes, and of all texts where nothing could be learned: the learned share of good texts.
    empty_score: float


def difference(sizer: Sizer, text: str) -> float:
    """How many bytes of twenty the good dictionary saves over the bad one; positive for good text."""
    data = text.encode("utf-8", "surrogatepass")
    good, bad = sizer.sizes(data)
    return 20.0 * (bad - good) / len(data)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights with the intercept first, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _differences(texts: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    """doc_id and x, the normalised difference, of whole non-empty texts."""
    held = texts.sparkSession.sparkContext.broadcast((good, bad))

    def make():
        sizer = Sizer(list(held.value))
        return lambda batch: {"doc_id": batch.column(0), "x": [difference(sizer, t) for t in batch.column(1).to_pylist()]}

    return arrow_map(texts.select("doc_id", "text"), "doc_id long, x double", make)


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, dictionary_rows: int = 375, calibration_rows: int = 750, slice_chars: int = 350, dictionary_bytes: int = 131072, seed: int = 13) -> QualityModel:
    """Dictionaries and calibration from a bounded sample of the labelled rows for which ``learn`` holds.

    The bounds are parameters: of each class ``dictionary_rows`` documents give a slice of ``slice_chars`` characters
    at a hashed place of the whole text, and ``calibration_rows`` further ones give their normalised difference, which
    is computed on the executors from whole texts. A class with fewer documents gives half to either. Classes are
    weighted by their share of all labels. Null labels aren't learned from; a document with several labels counts as
    its largest, and rows that repeat an id count once. Without labels of both classes every text scores the share of
    good labels, or 0.5 without any.
    """
    small_batches(docs.sparkSession)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = {0: 0, 1: 0} | {r["quality"]: r["count"] for r in marks.groupBy("quality").count().collect()}
    share = (n[1] + 1) / (n[0] + n[1] + 2)
    nothing = QualityModel(b"", b"", (0.0, 0.0), share)
    if not n[0] or not n[1]:
        return nothing
    wanted = dictionary_rows + calibration_rows
    place = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30))
    bound = lambda q: F.lit(int(min(1.0, 1.5 * (wanted + 10) / n[q]) * (1 << 30)))
    chosen = marks.where(place < F.when(F.col("quality") == 1, bound(1)).otherwise(bound(0))).withColumn("place", place)  # at most about 1.5 times what is wanted
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text <> ''")
    parts = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality", "place").agg(F.min(hashed_slice(F.col("text"), slice_chars, seed)).alias("part"))
    got = sorted((r["place"], r["doc_id"], r["part"], r["quality"]) for r in parts.collect())
    per = {q: [(d, t) for _, d, t, y in got if y == q][:wanted] for q in (0, 1)}
    if min(map(len, per.values())) < 2:
        return nothing
    first = {q: min(dictionary_rows, len(x) // 2) for q, x in per.items()}
    good, bad = (make_dictionary([t.encode("utf-8", "surrogatepass") for _, t in per[q][: first[q]]], dictionary_bytes) for q in (1, 0))
    rest = docs.sparkSession.createDataFrame([(d, q) for q in (0, 1) for d, _ in per[q][first[q] :]], "doc_id long, quality int")
    compared = _differences(texts.join(F.broadcast(rest), "doc_id", "left_semi"), good, bad).groupBy("doc_id").agg(F.min("x").alias("x"))
    rows = sorted((r["doc_id"], r["x"], r["quality"]) for r in compared.join(F.broadcast(rest), "doc_id").collect())
    x, y = np.array([[r[1]] for r in rows]), np.array([float(r[2]) for r in rows])
    w = _logistic(x, y)
    sampled = (y.sum() + 0.5) / (len(y) - y.sum() + 0.5)
    w[0] += np.log(n[1] / n[0]) - np.log(sampled)  # from the sample's share of good texts to that of all labels
    return QualityModel(good, bad, (float(w[0]), float(w[1])), share)


class QualityScorer:
    def __init__(self, model: QualityModel):
        self.model, self.sizer = model, Sizer([model.good, model.bad])

    def score(self, text: str | None) -> float:
        """Probability that the text is good; the share of good labels for an empty text."""
        if not text or not self.model.good:
            return self.model.empty_score
        a, b = self.model.weights
        return float(1 / (1 + np.exp(-np.clip(a + b * difference(self.sizer, text), -30, 30))))


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text.

    Null and empty texts score the share of good labels. Equal texts score the same; repeated rows give
    repeated rows. Only doc_id and text are read. No shuffle; the model's size is bounded.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = QualityScorer(held.value)
        return lambda batch: {"doc_id": batch.column(0), "score": [scorer.score(t) for t in batch.column(1).to_pylist()]}

    small_batches(docs.sparkSession)
    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id long, score double", make)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text, learned where crc32(doc_id) mod 5 is not 0."""
    docs = documents(spark, sf_dir)
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_mod("doc_id", 5) != 0)
    return score_quality(docs, model).withColumn("held_out", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))).select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
