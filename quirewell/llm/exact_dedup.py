"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest, one row per distinct text.
New rows are reduced to one row per digest (partial aggregation first, so a hot
text shrinks before it is shuffled), anti-joined against the index by sort-merge
and appended with the name of their batch, so that a batch decided again (its
result was lost) gets the same decisions. DataFrame functions only.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, forget, keep, partitions, work_dir

#: A digest with this share of all rows is joined by broadcast: 1 / HOT_SHARE rows at most.
HOT_SHARE = 1 / 2000


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text without ASCII white space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), ASCII_SPACE + "+", ""), 256)


@dataclass
class DigestIndex:
    """``digest string, keep_id, group_size, batch string``: one row for each text seen, bucketed and sorted by digest."""

    spark: SparkSession
    table: str
    path: str
    buckets: int

    @classmethod
    def create(cls, spark: SparkSession, path: str, table: str | None = None, buckets: int | None = None) -> DigestIndex:
        """The index of this table, an empty one if there is none."""
        index = cls(spark, table or f"digest_index_{uuid.uuid4().hex}", path, buckets or partitions(spark))
        if not spark.catalog.tableExists(index.table):
            spark.sql(f"CREATE TABLE {index.table} (digest STRING, keep_id BIGINT, group_size BIGINT, batch STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {index.buckets} BUCKETS LOCATION '{path}'")
        return index

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, groups: DataFrame, batch: str) -> None:
        """Add the digests that the index lacks as those of ``batch``; a sort-merge anti-join reads the index without a shuffle."""
        fresh = groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        (fresh.select("digest", "keep_id", "group_size", F.lit(batch).alias("batch")).repartition(self.buckets, "digest")
         .write.format("parquet").mode("append").option("path", self.path)
         .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.table))


def batch_name(rows: DataFrame) -> str:
    """A name that equal sets of rows share, whatever their order."""
    h = F.xxhash64(*rows.columns)
    r = rows.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.sum((h % 1_000_003) * (h % 999_983))).first()
    return "-".join(str(x or 0) for x in r)


def decide(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after deleting ASCII white space. Of equal
    texts the one with the most code points in the original, then the smallest
    id, stays. With an ``index`` that already holds a text, the earlier keep_id
    stands and no new row of that text is kept; group_size is that of the batch
    which first brought the text. A batch may be decided again, even after its
    digests were appended in whole or in part: what the index holds of the same
    ``batch`` (by default a fingerprint of the batch's ids and texts) is its own.

    Null and empty texts are equal to one another. A null id loses every tie; a
    group of null ids only has a null keep_id and keeps its rows. Repeated rows
    (same id, same text) carry the same decision, so both are kept or neither
    is. Other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    home = work_dir(spark)
    rows = keep(docs.select(F.col(id_col).alias("doc_id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("size"), digest(F.col(text_col)).alias("digest")), f"{home}/digests")
    # the greatest of (size, not null, -id) is the longest text with the smallest id
    best = F.max(F.struct("size", F.col("doc_id").isNotNull().alias("has"), (-F.col("doc_id")).alias("back")))
    groups = rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")).select("digest", (-F.col("best.back")).alias("keep_id"), "group_size")
    own = index is None
    index = index or DigestIndex.create(spark, f"{home}/index")
    if own:
        forget(spark, index.table)
    batch = batch or batch_name(rows)
    index.append(groups, batch)
    table = index.read()
    at_least = max(1000, int(rows.count() * HOT_SHARE))
    hot = keep(table.filter(F.col("group_size") >= at_least), f"{home}/hot")
    few = hot.count() <= 2 / HOT_SHARE  # always so for one batch; an old index may hold more
    hot_rows = rows.join(F.broadcast(hot) if few else hot, "digest")
    rest = rows.join(F.broadcast(hot.select("digest")) if few else hot.select("digest"), "digest", "left_anti").join(table.hint("merge"), "digest")
    out = hot_rows.unionByName(rest)
    kept = (F.col("batch") == batch) & F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS size,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY size DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
