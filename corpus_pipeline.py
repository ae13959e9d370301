"""The corpus pipeline: quality, exact copies, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's rows as Parquet and reads them again as the next one's ``docs``. All
stages but the last return the columns of ``docs``. Rows that a stage keeps pass
whole, null ids and texts included; rows are told apart by doc_id and text, so of
several texts of one doc_id only the one decided on goes or changes. An empty
table passes through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirewell.llm import exact_dedup, near_dedup, packing, quality, substring_dedup
from quirewell.llm.common import BROADCAST_IDS, keep, work_dir

#: Words that packing remembers, fewer than by itself: executors come to it with what other stages left in memory.
PACKING_WORDS = 50_000
#: A passage of so many words that an earlier document has goes.
PASSAGE_WORDS = 50


def _without(docs: DataFrame, gone: DataFrame, mark: Column, home: str) -> DataFrame:
    """The rows of ``docs`` but those whose doc_id and ``mark`` of the text are in ``gone``, ``doc_id, mark``; a null id is never."""
    gone = keep(gone.distinct(), f"{home}/gone").toDF("gone_id", "gone_mark")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, (F.col("doc_id") == F.col("gone_id")) & (mark == F.col("gone_mark")), "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the classifier's threshold go."""
    rows, total = quality.labelled_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, quality.fit(rows, total=total))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original, then the smallest id, stays. Rows with a null id can't be named, so they all stay."""
    decided = exact_dedup.decide(docs)
    return _without(docs, decided.where("NOT kept").select("doc_id", "text_sha256"), exact_dedup.digest(F.col("text")), work_dir(spark))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the smallest id stays; a row with a null id stays."""
    decided = near_dedup.near_duplicates(docs)
    return _without(docs, decided.where("NOT kept").select("doc_id", "row"), F.xxhash64("text"), work_dir(spark))


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE_WORDS words or more that an earlier document has go; a text of which nothing is left stays as an empty one."""
    home = work_dir(spark)
    changed = substring_dedup.deduplicate_substrings(docs, window=PASSAGE_WORDS, with_text=True).where("n_removed > 0")
    changed = keep(changed.select("doc_id", "row", "kept_text").distinct(), f"{home}/changed")
    left = _without(docs, changed.select("doc_id", "row"), substring_dedup.row_key(), home)
    few = changed.count() <= BROADCAST_IDS
    keys = changed.select(F.col("doc_id").alias("changed_id"), F.col("row").alias("changed_row"), "kept_text")
    same = (F.col("doc_id") == F.col("changed_id")) & (substring_dedup.row_key() == F.col("changed_row"))
    only = keys.drop("kept_text")  # the few rows that change are found before texts are joined with texts
    touched = docs.join(F.broadcast(only) if few else only, same, "left_semi").join(keys, same)
    size = lambda c: F.length("kept_text").cast(docs.schema[c].dataType)
    columns = [F.col("kept_text").alias(c) if c == "text" else size(c).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return left.unionByName(touched.select(*columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), remember=PACKING_WORDS)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("passages", passage_stage),
    ("packing", packing_stage),
]

#: The classifier, the passages' removal and the packing are beyond SQL; tests/llm/test_whole.py compares each stage's rows with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    home = work_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = keep(stage(spark, docs, sf_dir), f"{home}/{i}-{name}")
    return docs
