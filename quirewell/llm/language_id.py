"""Language of a text: sparse multinomial logistic regression on TF-IDF of character n-grams.

Weights are learned online with follow-the-regularised-leader under elastic-net
penalties, and probabilities are calibrated by a temperature on texts that the
weights have not seen. Document frequencies are counted over all training rows;
the weights are fitted on a bounded sample of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, smallest, work_dir

#: Training rows that the weights are fitted on at most, in all and for each language; their texts are taken whole.
SAMPLE_ROWS, SAMPLE_PER_LANGUAGE = 8000, 1500
BITS, ORDERS, EPOCHS = 15, 3, 3
ALPHA, BETA, L1, L2 = 0.8, 1.0, 1e-4, 1e-5
UNKNOWN = "und"

NOT_LETTERS = re.compile(r"[\W\d_]+")
LETTER = re.compile(r"[^\W\d_]")
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def gram_counts(text: str) -> np.ndarray:
    """How often each bucket of n-grams (1 to ORDERS letters, runs of other characters as one space) occurs."""
    plain = " " + NOT_LETTERS.sub(" ", text.lower()).strip() + " "
    c = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    parts, h = [], np.zeros(len(c), dtype=np.uint64)
    for n in range(min(ORDERS, len(c))):
        h = h[: len(c) - n] + (c[n:] + np.uint64(n + 1)) * _FACTORS[n]
        parts.append(((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS))
    return np.bincount(np.concatenate(parts).astype(np.int64), minlength=1 << BITS)


def tf_idf(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their weights, of length 1."""
    counts = gram_counts(text)
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    return at, x / (np.sqrt((x * x).sum()) or 1.0)


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # bucket by language
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, text: str) -> np.ndarray:
        at, x = tf_idf(text, self.idf)
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not LETTER.search(text) or not self.languages:
            return UNKNOWN, 0.0
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the texts each bucket occurs, and the number of texts; summed up in each task, then over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                df += gram_counts(text) > 0
                n += 1
        if n:
            at = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n), pa.int64())], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # 2 ** BITS rows at most
    df, n = np.zeros(1 << BITS, np.int64), 0
    for r in rows:
        if r["bucket"] < 0:
            n = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    return df, n


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases after EPOCHS passes of FTRL-proximal with L1 and L2 penalties."""
    z, n = np.zeros((1 << BITS, k)), np.zeros((1 << BITS, k))
    zb, nb = np.zeros(k), np.zeros(k)

    def solve(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            w, b = solve(z[at], n[at], L1), solve(zb, nb, 0.0)
            s = x @ w + b
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
            zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / ALPHA * b
            nb += p * p
    return solve(z, n, L1), solve(zb, nb, 0.0)


def best_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, between 1/20 and 20."""
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))

    def loss(t: float) -> float:
        s = logits / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    return float(min(grid, key=loss)) if len(y) else 1.0


def fit(rows: DataFrame) -> LanguageModel:
    """Fit on ``doc_id, text, lang``. Rows with a null lang, or whose text is null or has no letter, teach nothing."""
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    df, n = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + df)) + 1
    languages = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not languages:
        return LanguageModel([], idf, np.zeros((1 << BITS, 0)), np.zeros(0))
    each = max(1, min(SAMPLE_PER_LANGUAGE, SAMPLE_ROWS // len(languages)))
    chosen = smallest(rows.select("doc_id", "lang", F.length("text").alias("size")), "lang", each)
    picked = rows.withColumn("size", F.length("text")).join(F.broadcast(chosen.distinct()), ["doc_id", "lang", "size"])  # SAMPLE_ROWS at most
    texts = [(r["text"], languages.index(r["lang"])) for r in picked.select("doc_id", "lang", "text").orderBy("doc_id", "lang", "text").collect()]
    data = [(*tf_idf(t, idf), y) for t, y in texts if LETTER.search(t)]
    fitted, held = [x for i, x in enumerate(data) if i % 5], data[::5]
    weights, bias = follow_the_leader(fitted, len(languages))
    logits = np.array([x @ weights[at] + bias for at, x, _ in held]).reshape(len(held), len(languages))
    return LanguageModel(languages, idf, weights.astype(np.float32), bias, best_temperature(logits, np.array([y for *_, y in held], dtype=int)))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, lang_pred, score``, of whole texts.

    A text that is null or has no letter is ``und`` with a score of 0, as is
    every text of a model without languages. Repeated rows and null ids are
    kept; only the id and the text are read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    work_dir(docs.sparkSession)  # for its bound on batches

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                found = [model.predict(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    found = identify(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
