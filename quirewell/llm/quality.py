"""Quality by compression: which of two Zstandard dictionaries, of good and of bad text, shortens a text more.

The sizes' normalised difference, with the rate of compression (repetition
shrinks under either dictionary), is calibrated to a probability. The dictionaries and the calibration are fitted on a bounded sample of labelled
rows; every text is scored whole, in blocks, so that a dictionary keeps its
effect on long texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import keep, pieces, smallest, work_dir

#: Labelled rows of each class that the model is fitted on at most; their texts are taken whole.
SAMPLE_ROWS = 1200
DICTIONARY_BYTES = 64 << 10
BLOCK_BYTES = 2048
LEVEL = 3


def _blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]


def _dictionary(texts: list[bytes]) -> bytes:
    parts = [b for t in texts for b in _blocks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts, k=512, d=8).as_bytes()
    except zstandard.ZstdError:  # too little text: the text itself
        return b"".join(parts)[-DICTIONARY_BYTES:] or b" "


@dataclass
class CompressionModel:
    """Two dictionaries and the logistic curve from compressed sizes to a probability."""

    good: bytes
    bad: bytes
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)
    usual_rate: float = -1.0

    def _tools(self) -> tuple:
        if "_made" not in self.__dict__:
            make = lambda d: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
            self._made = (make(self.good), make(self.bad))
        return self._made

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def features(self, data: bytes) -> tuple[float, float]:
        """(size with the bad dictionary - size with the good one) / their sum; log of the smaller size over the text's. An empty text: 0 and the usual rate."""
        good, bad = self._tools()
        g = b = 0
        for block in _blocks(data):
            g += len(good.compress(block))
            b += len(bad.compress(block))
        return ((b - g) / (b + g), math.log(min(b, g) / len(data))) if data else (0.0, self.usual_rate)

    def score(self, text: str | None) -> float:
        x, rate = self.features((text or "").encode())
        z = self.weights[0] * x + self.weights[1] * rate + self.weights[2]
        return 1 / (1 + math.exp(-min(40.0, max(-40.0, z))))


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton's method, targets drawn in a little (Platt)."""
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((y == 0).sum() + 2))
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(3), z.T @ (weight * (t - p)) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    slope = w[:2] / scale
    return float(slope[0]), float(slope[1]), float(w[2] - slope @ mean)


def _class_counts(rows: DataFrame) -> dict[int, int]:
    return {r["quality"]: r["n"] for r in rows.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, total: dict[int, int] | None = None) -> CompressionModel:
    """Fit on ``doc_id, text, quality``: a bounded sample of each class, the same at every run.

    Dictionaries come from two thirds of the sample, the calibration from the
    rest, weighted by the classes' shares of all labelled rows: ``total`` if
    ``labelled`` is only what can be sampled of them. Null labels and
    texts are left out. With one class only, every score is that class's
    share; without labels it is one half.
    """
    rows = labelled.where("quality IN (0, 1) AND text IS NOT NULL")
    total = _class_counts(rows) if total is None else total
    sample: dict[int, list[bytes]] = {}
    for q in (0, 1):
        # the rows with the smallest hashes
        chosen = rows.where(F.col("quality") == q).select("doc_id", F.xxhash64("doc_id").alias("h"), "text").orderBy("h", "doc_id", "text").limit(sample_rows)
        sample[q] = [r["text"].encode() for r in chosen.collect()]
    good, bad = sample[1], sample[0]
    n = sum(total.values())
    if not good or not bad:
        share = (total.get(1, 0) + 0.5) / (n + 1)
        return CompressionModel(b" ", b" ", (0.0, 0.0, float(np.log(share / (1 - share)))))
    model = CompressionModel(_dictionary([x for i, x in enumerate(good) if i % 3]), _dictionary([x for i, x in enumerate(bad) if i % 3]))
    # a class of very few texts calibrates on what the dictionary saw too
    held = [(x, y) for texts, y in ((good, 1), (bad, 0)) for i, x in enumerate(texts) if not i % 3 or len(texts) < 6]
    x = np.array([model.features(t) for t, _ in held if t])
    y = np.array([c for t, c in held if t])
    weight = np.where(y == 1, total[1] / max(1, (y == 1).sum()), total[0] / max(1, (y == 0).sum()))
    model.weights, model.usual_rate = _calibrate(x, y, weight / weight.mean()), float(x[:, 1].mean())
    return model


def classify(docs: DataFrame, model: CompressionModel, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, score, predicted``.

    Whole texts are scored. Null and empty texts have the score of no evidence,
    the calibrated value of no difference at the usual rate. Repeated rows and null ids are
    kept; only the id and the text are read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                score = [model.score(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def keep_good(docs: DataFrame, model: CompressionModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose whole text scores ``threshold`` or more; only the text leaves the JVM."""

    @arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t) >= threshold for t in texts.to_pylist()], pa.bool_())

    work_dir(docs.sparkSession)  # for its bound on batches
    return docs.where(good(F.col(text_col)))


def held_out(doc_id: F.Column, folds: int, fold: int) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_rows(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """Of labelled documents outside the held-out fold: ``doc_id, text, quality`` of those that can be sampled, and the number of all in each class."""
    own = labels.select("doc_id", "quality").where("doc_id IS NOT NULL AND quality IN (0, 1)").dropDuplicates()
    own = own.where(~held_out(F.col("doc_id"), 5, 0))
    known = keep(docs.where("text IS NOT NULL").select("doc_id").join(own, "doc_id"), f"{work_dir(docs.sparkSession)}/labelled")
    # only ids among the smallest hashes can be sampled
    few = smallest(known.dropDuplicates(), "quality", SAMPLE_ROWS)
    return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id"), _class_counts(known)  # 2 * SAMPLE_ROWS ids at most


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, total = labelled_rows(docs, labels)
    model = fit(rows, total=total)
    scored = classify(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")
