"""Reranking of candidates by a pluggable scorer: preparation, checks, coverage and the gate before it."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Candidates that are sent, characters of each, and the range of top_n.
MOST, CHARS, LEAST_TOP, MOST_TOP = 100, 600, 1, 50


def prepare(candidates: DataFrame, text: str = "content") -> DataFrame:
    """``index, document`` of the first MOST candidates (``index`` from 0): cut, trimmed, no blanks, each text once."""
    cut = candidates.where(F.col("index") < MOST).select("index", F.trim(F.substring(text, 1, CHARS)).alias("document")).where("document <> ''")
    return cut.groupBy("document").agg(F.min("index").alias("index")).select("index", "document")


def problems(scores: DataFrame, count: int) -> DataFrame:
    """``problem`` of an answer ``index, score``: empty, outside, repeated or not a number; none if it is sound."""
    s = F.coalesce("score", F.lit(0.0))
    each = scores.select(F.when((F.col("index") < 0) | (F.col("index") >= count), "outside").when(F.isnan(s) | (F.abs(s) == float("inf")), "not finite").alias("problem")).where("problem IS NOT NULL")
    twice = scores.groupBy("index").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("repeated").alias("problem"))
    none = scores.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("empty").alias("problem"))
    return each.union(twice).union(none).distinct()


def coverage(ranked: DataFrame, top_n: int, per_book: int = 2) -> DataFrame:
    """Of ``rank, book_id`` the first ``top_n``: at most ``per_book`` of a book, then the rest in order."""
    rn = F.row_number().over(Window.partitionBy("book_id").orderBy("rank"))
    over = ranked.withColumn("rn", rn).withColumn("over", F.col("rn") > max(1, per_book))
    return over.orderBy("over", "rank").limit(top_n).drop("rn", "over")


@dataclass
class Settings:
    enabled: bool = False
    provider: str = ""
    endpoint: str = ""
    model: str = ""
    top_n: int = 10

    def usable(self) -> bool:
        return self.enabled and all(x.strip() for x in (self.provider, self.endpoint, self.model)) and LEAST_TOP <= self.top_n <= MOST_TOP


def rerank(candidates: DataFrame, query: str, mode: str, settings: Settings, scorer: Callable[[str, list[str]], Sequence[tuple[int, float]]]) -> tuple[DataFrame, str]:
    """``candidates`` (``index, content``) in the scorer's order, and a warning.

    Only for a question, and only if the settings are complete; if the scorer
    fails or its answer isn't sound the order stays. MOST documents at most go
    through the driver, to a service outside.
    """
    if mode != "ask" or not query.strip() or not settings.usable():
        return candidates.orderBy("index"), ""
    sent = [(r["index"], r["document"]) for r in prepare(candidates).orderBy("index").collect()]
    try:
        answer = list(scorer(query, [d for _, d in sent]))
        at = [i for i, _ in answer]
        if not answer or len(set(at)) < len(at) or not all(0 <= i < len(sent) for i in at) or not all(math.isfinite(s) for _, s in answer):
            raise ValueError("the answer of the reranker isn't sound")
    except Exception as e:  # noqa: BLE001  whatever a service does, the search goes on
        return candidates.orderBy("index"), f"{e}; the order stays"
    order = candidates.sparkSession.createDataFrame([(sent[i][0], k, float(s)) for k, (i, s) in enumerate(answer)], "index bigint, place int, rerank double")
    joined = candidates.join(F.broadcast(order), "index", "left")
    return joined.orderBy(F.col("place").asc_nulls_last(), "index").drop("place"), ""
