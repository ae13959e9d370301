"""Import jobs and imported sources: lists, deletion, previews, resumption, progress, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States that a job never leaves, characters and chunks of an import at most, chunks and characters of a preview.
TERMINAL = ("completed", "cancelled", "failed")
MOST_CHARS, MOST_CHUNKS, PREVIEW_CHUNKS, PREVIEW_CHARS = 40_000_000, 5000, 5, 400


def source_list(sources: DataFrame, chunks: DataFrame, deleted_too: bool = False) -> DataFrame:
    """Sources with their number of chunks and characters, 0 if there are none."""
    n = chunks.groupBy("source_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.char_length("content")).alias("chars"))
    rows = sources if deleted_too else sources.where(~F.col("is_deleted"))
    return rows.join(n, "source_id", "left").withColumns({"chunks": F.coalesce("chunks", F.lit(0)), "chars": F.coalesce("chars", F.lit(0))})


def source_detail(sources: DataFrame, chunks: DataFrame, source_id: str) -> DataFrame:
    return sources.where(F.col("source_id") == source_id).join(chunks, "source_id").orderBy("position")


def delete_sources(sources: DataFrame, ids: DataFrame) -> DataFrame:
    """Soft: the rows stay, marked."""
    gone = ids.select("source_id", F.lit(True).alias("gone")).distinct()
    return sources.join(gone, "source_id", "left").withColumn("is_deleted", F.col("is_deleted") | F.coalesce("gone", F.lit(False))).drop("gone")


def purge(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """For good, of sources or of what hangs on them."""
    return rows.join(ids.select(key).distinct(), key, "left_anti")


def delete_jobs(jobs: DataFrame, children: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs and their staged rows without the named jobs; jobs that still run stay."""
    gone = jobs.where(F.col("status").isin(*TERMINAL)).join(ids.select("job_id").distinct(), "job_id", "left_semi").select("job_id")
    return purge(jobs, gone, "job_id"), purge(children, gone, "job_id")


def prune(jobs: DataFrame, children: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """``children`` (``job_id``) without those of jobs that ended more than ``days`` days ago; jobs stay, as do rows of unknown jobs."""
    old = jobs.where(F.col("status").isin(*TERMINAL) & (F.col("finished_at") < now - F.lit(days * 86400))).select("job_id")
    return purge(children, old, "job_id")


def preview(chunks: DataFrame, known: DataFrame) -> DataFrame:
    """The first chunks of each import, cut, and whether its content (``hash``) is known."""
    first = chunks.where(F.col("position") < PREVIEW_CHUNKS).select("source_id", "position", F.substring("content", 1, PREVIEW_CHARS).alias("content"), "hash")
    return first.join(known.select("hash", F.lit(True).alias("k")).distinct(), "hash", "left").select("source_id", "position", "content", F.coalesce("k", F.lit(False)).alias("duplicate"))


def size_verdict(chunks: Column, chars: Column) -> Column:
    """What speaks against an import by its size."""
    return F.when((F.coalesce(chunks, F.lit(0)) == 0) | (F.coalesce(chars, F.lit(0)) == 0), "empty").when(chars > MOST_CHARS, "too large").otherwise("ok")


def sequence_positions(rows: DataFrame, group: str, order: str, count: str) -> DataFrame:
    """``first``: how many chunks the earlier rows of the group have, so that numbering goes on across chapters."""
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("first", F.coalesce(F.sum(count).over(before), F.lit(0)).cast("bigint"))


def unstaged(pages: DataFrame, staged: DataFrame) -> DataFrame:
    """After a restart: the pages whose revision isn't staged yet."""
    return pages.join(staged.select("page_id", "revision_id"), ["page_id", "revision_id"], "left_anti")


def stage(staged: DataFrame, pages: DataFrame) -> DataFrame:
    """``page_id, revision_id, summary, publish_status``: new pages come as pending; of staged ones only those still pending take another revision."""
    p = pages.select("page_id", F.col("revision_id").alias("r"), F.col("summary").alias("x"), F.lit(True).alias("new"))
    j = staged.join(p, "page_id", "full_outer")
    take = F.col("new") & (F.col("publish_status").isNull() | ((F.col("publish_status") == "pending") & (F.col("r") != F.col("revision_id"))))
    pick = lambda a, b: F.when(take, a).otherwise(b)
    return j.select("page_id", pick(F.col("r"), F.col("revision_id")).alias("revision_id"), pick(F.col("x"), F.col("summary")).alias("summary"), F.coalesce("publish_status", F.lit("pending")).alias("publish_status"))


def mark_missing(terms: DataFrame, seen: DataFrame, full_run: bool) -> DataFrame:
    """After a full run, encyclopedia terms that the dump lacks are ``source_missing``, but for ignored ones; those that are back are pending."""
    if not full_run:
        return terms
    s = terms.join(seen.select("term", F.lit(True).alias("seen")).distinct(), "term", "left")
    of_source = F.col("source") == "encyclopedia"
    status = F.when(of_source & F.col("seen").isNull() & (F.col("status") != "ignored"), "source_missing").when(of_source & F.col("seen") & (F.col("status") == "source_missing"), "pending").otherwise(F.col("status"))
    return s.withColumn("status", status).drop("seen")


def progress(steps: DataFrame) -> DataFrame:
    """``job_id, at, percent`` of ``job_id, at, done, total``: from 10 to 90 with what is done, 100 at the end, never back."""
    w = Window.partitionBy("job_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    share = F.when(F.col("total") > 0, F.least(F.lit(1.0), F.col("done") / F.col("total"))).otherwise(0.0)
    now = F.when((F.col("total") > 0) & (F.col("done") >= F.col("total")), 100).otherwise(F.floor(10 + 80 * share))
    return steps.select("job_id", "at", F.max(now).over(w).cast("int").alias("percent"))


def report(jobs: DataFrame, staged: DataFrame, issues: DataFrame, examples: int = 20) -> DataFrame:
    """``job_id, conclusion, accepted, filtered, reasons, codes, examples`` of each job.

    A finished job with conflicts or parse errors is a partial success. The
    first ``examples`` issues stand for the others.
    """
    count = lambda d, c, name: d.groupBy("job_id", c).agg(F.count(F.lit(1)).alias("n")).groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct(F.col(c).alias("what"), "n"))).alias(name))  # noqa: E731  kinds are few
    s = staged.groupBy("job_id").agg(F.count_if(F.col("filter_status") == "accepted").alias("accepted"), F.count_if(F.col("filter_status") != "accepted").alias("filtered"))
    rn = F.row_number().over(Window.partitionBy("job_id").orderBy("issue_id"))
    first = issues.withColumn("rn", rn).where(F.col("rn") <= examples).groupBy("job_id").agg(F.array_sort(F.collect_list("issue_id")).alias("examples"))
    hard = issues.groupBy("job_id").agg(F.count_if(F.col("code") == "parse_error").alias("hard"), F.count_if(F.col("code") == "conflict").alias("conflicts"))
    j = jobs.join(s, "job_id", "left").join(count(staged.where("filter_status <> 'accepted'"), "filter_status", "reasons"), "job_id", "left").join(count(issues, "code", "codes"), "job_id", "left").join(first, "job_id", "left").join(hard, "job_id", "left")
    bad = (F.coalesce("hard", F.lit(0)) > 0) | (F.coalesce("conflicts", F.lit(0)) > 0)
    conclusion = F.when((F.col("status") == "completed") & bad, "partial_success").when(F.col("status") == "completed", "success").when(F.col("status").isin("cancelled", "paused", "failed"), F.col("status")).otherwise("in_progress")
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return j.select("job_id", conclusion.alias("conclusion"), n("accepted"), n("filtered"), "reasons", "codes", "examples")
