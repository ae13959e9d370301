"""Ingestion: page classification, redirects, chunks, staging and publishing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: Fixed values of chunking: characters of a window, of the overlap, and chunks of a document.
WINDOW, OVERLAP, MOST = 1200, 150, 5000


def chunk_text(text: str, window: int = WINDOW, overlap: int = OVERLAP, most: int = MOST) -> list[str]:
    """Windows that end after the last line break inside them, if it isn't their first character.

    The next window begins ``overlap`` characters before that end, or right at
    it if the window was no longer than the overlap.
    """
    out, at, n = [], 0, len(text)
    while at < n and len(out) < most:
        line = text.rfind("\n", at + 1, at + window)
        stop = line + 1 if line >= 0 else min(n, at + window)
        piece = text[at:stop].strip()
        if piece:
            out.append(piece)
        at = stop if stop >= n or stop - at <= overlap else stop - overlap
    return out


@udtf(returnType=StructType([StructField("position", IntegerType()), StructField("content", StringType())]))
class Chunks:
    """Table function of ``chunk_text`` for LATERAL joins."""

    def eval(self, text: str):
        yield from enumerate(chunk_text(text or ""))


def chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, position, content``: documents cut in Arrow batches."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, p, c) for i, t in zip(f["id"], f["text"], strict=True) for p, c in enumerate(chunk_text(t or ""))]
            yield pd.DataFrame(rows, columns=["id", "position", "content"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, position int, content string")


def classify(title: Column, redirect: Column, text: Column, disambiguation: Column, list_page: Column, soft_redirect: Column) -> Column:
    """A page's fate, the first that applies."""
    plain = F.trim(F.coalesce(text, F.lit("")))
    return (
        F.when(F.trim(F.coalesce(title, F.lit(""))) == "", "empty_title").when(redirect.isNotNull(), "redirect").when(soft_redirect, "soft_redirect")
        .when(disambiguation, "disambiguation").when(list_page, "list_page").when(plain == "", "empty").when(F.char_length(plain) < 12, "too_short").otherwise("accepted")
    )


#: Pages of one task where pages are joined with pages.
TASK_PAGES = 100_000


def _dealt(rows: DataFrame, key: str, tasks: int) -> DataFrame:
    """One side of a join on ``key`` in ``tasks`` parts; never broadcast, as files of pages look smaller than their rows are."""
    return rows.repartition(tasks, key).hint("merge")


def resolve_redirects(pages: DataFrame, depth: int = 10) -> DataFrame:
    """``page_id, final, outcome`` of each redirect: ok, loop, too_deep or broken.

    A walk begins at the redirect's target and takes ``depth`` steps at most,
    each a join on the page's key; a page met twice is a loop, and a walk that
    stands on a redirect after its last step is too deep. Only ids take part,
    in tasks of about TASK_PAGES pages.
    """
    tasks = 1 + pages.count() // TASK_PAGES
    hop = pages.where("target IS NOT NULL").select(F.col("page_id").alias("at"), F.col("target").alias("next"))
    known = pages.select(F.col("page_id").alias("at"), F.lit(True).alias("known"))
    walk = hop.select(F.col("at").alias("page_id"), F.col("next").alias("at"), F.array("next").alias("seen"), F.lit(None).cast("string").alias("outcome"))
    hop = _dealt(hop, "at", tasks)
    for i in range(depth + 1):
        step = _dealt(walk, "at", tasks).join(hop, "at", "left")
        state = F.when(F.col("next").isNull(), "ok")
        state = state.when(F.array_contains("seen", F.col("next")), "loop") if i < depth else state.otherwise("too_deep")
        walk = step.withColumn("outcome", F.coalesce("outcome", state)).select(
            "page_id", F.when(F.col("outcome").isNull(), F.col("next")).otherwise(F.col("at")).alias("at"),
            F.when(F.col("outcome").isNull(), F.array_append("seen", F.col("next"))).otherwise(F.col("seen")).alias("seen"), "outcome",
        )
    done = _dealt(walk, "at", tasks).join(_dealt(known, "at", tasks), "at", "left")
    outcome = F.when((F.col("outcome") == "ok") & F.col("known").isNull(), "broken").otherwise(F.col("outcome"))
    return done.select("page_id", F.col("at").alias("final"), outcome.alias("outcome"))


def aliases(pages: DataFrame, resolved: DataFrame) -> DataFrame:
    """``page_id, aliases``: the titles of the redirects (``resolve_redirects``) that end at a page, sorted, each once, its own left out."""
    tasks = 1 + pages.count() // TASK_PAGES
    title = _dealt(pages.select("page_id", "title"), "page_id", tasks)
    ends = _dealt(resolved.where("outcome = 'ok'").select("page_id", "final"), "page_id", tasks).join(title, "page_id").select(F.col("final").alias("page_id"), F.col("title").alias("alias"))
    named = _dealt(ends, "page_id", tasks).join(title, "page_id").where("alias <> title")
    return named.groupBy("page_id").agg(F.sort_array(F.collect_set("alias")).alias("aliases"))


def publish(stored: DataFrame, staged: DataFrame) -> DataFrame:
    """What happens to each staged page: insert, skip, snapshot, update or conflict.

    ``stored``: title, page_id, hash, edited; ``staged``: title, page_id, hash.
    """
    s = stored.select("title", F.col("page_id").alias("old_page"), F.col("hash").alias("old_hash"), "edited")
    j = staged.join(s, "title", "left")
    act = (
        F.when(F.col("old_page").isNull(), "insert").when(F.col("old_page") != F.col("page_id"), "conflict").when(F.col("old_hash") == F.col("hash"), "skip")
        .when(F.col("edited"), "snapshot").otherwise("update")
    )
    return j.select("page_id", "title", act.alias("action"))


def apply_publish(stored: DataFrame, staged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The terms after publishing, and the conflicts ``page_id, title, old_page``.

    ``stored``: title, page_id, hash, edited, text, snapshot; ``staged``: title,
    page_id, hash, text. New titles come; an unedited term takes text, snapshot
    and hash; an edited one keeps its text and takes the others; equal hashes
    change nothing; another page's title is a conflict and stays.
    """
    acts = publish(stored, staged).where("action <> 'skip'")
    new = staged.join(acts, ["page_id", "title"])
    fresh = new.where("action = 'insert'").select("title", "page_id", "hash", F.lit(False).alias("edited"), "text", F.col("text").alias("snapshot"))
    put = new.where("action IN ('update', 'snapshot')").select("title", "action", F.col("hash").alias("n_hash"), F.col("text").alias("n_text"))
    j = stored.join(put, "title", "left")
    text = F.when(F.col("action") == "update", F.col("n_text")).otherwise(F.col("text"))
    kept = j.select("title", "page_id", F.coalesce("n_hash", "hash").alias("hash"), "edited", text.alias("text"), F.coalesce("n_text", "snapshot").alias("snapshot"))
    conflicts = acts.where("action = 'conflict'").join(stored.select("title", F.col("page_id").alias("old_page")), "title").select("page_id", "title", "old_page")
    return kept.unionByName(fresh), conflicts


def validate_batch(staging: DataFrame, terms: DataFrame) -> DataFrame:
    """``job_id, accepted, redirects, filtered, title_conflicts, alias_conflicts, publishable`` of staged pages.

    ``staging``: job_id, page_id, title, outcome; ``terms``: term, source,
    page_id. A title conflicts if a term of another source or page has it; a
    redirect's if another page of the encyclopedia has. What is accepted and has
    no conflict can be published.
    """
    t = terms.select(F.col("term").alias("title"), F.col("source").alias("t_source"), F.col("page_id").alias("t_page"))
    other = F.col("t_page").isNull() | (F.col("t_page") != F.col("page_id"))
    j = staging.join(t, "title", "left")
    wiki = F.col("t_source") == "encyclopedia"
    clash = F.col("t_source").isNotNull()
    marked = j.groupBy("job_id", "page_id", "title", "outcome").agg(F.count_if(clash & (~wiki | other)).alias("titles"), F.count_if(clash & wiki & F.col("t_page").isNotNull() & other).alias("aliases"))
    is_ = lambda x: F.col("outcome") == x
    counts = marked.groupBy("job_id").agg(
        F.count_if(is_("accepted")).alias("accepted"), F.count_if(is_("redirect")).alias("redirects"), F.count_if(~F.col("outcome").isin("accepted", "redirect")).alias("filtered"),
        F.coalesce(F.sum(F.when(is_("accepted"), F.col("titles"))), F.lit(0)).alias("title_conflicts"), F.coalesce(F.sum(F.when(is_("redirect"), F.col("aliases"))), F.lit(0)).alias("alias_conflicts"),
    )
    return counts.withColumn("publishable", F.greatest(F.lit(0), F.col("accepted") - F.col("title_conflicts")))


def content_hash(kind: Column, title: Column, body: Column) -> Column:
    return F.md5(F.concat_ws("|", kind, F.lower(F.trim(title)), body))
