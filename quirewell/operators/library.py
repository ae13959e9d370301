"""Library queries: counts, filtered lists, pages, and maintenance by overlay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import when_text
from ..sources import folders

BLANK = "Uncategorised"


def settle(df: DataFrame) -> DataFrame:
    """A table that several parts of a plan read: written to a shared work folder, so that it is computed once and outlives executors."""
    return folders.write(df, folders.work_folder(df.sparkSession))


def like_any(pattern: str, *columns: Column | str) -> Column:
    """``%pattern%`` over any column; ASCII letters of either case, ``%`` and ``_`` of the caller act as wildcards."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    return reduce(Column.__or__, [F.lower(F.coalesce(c, F.lit(""))).like(f"%{pattern.strip().lower()}%") for c in cols])


def blank_bucket(c: Column) -> Column:
    return F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.lit(BLANK)).otherwise(c)


def reading_status(highlights: Column, thoughts: Column) -> Column:
    started = (F.coalesce("read_update_time", F.lit(0)) > 0) | (highlights > 0) | (thoughts > 0)
    return F.when(F.col("finish_reading"), "finished").when(started, "reading").otherwise("unread")


def book_list(books: DataFrame, highlights: DataFrame, thoughts: DataFrame) -> DataFrame:
    """Live books with their counts, progress and status. Notes are counted before they are joined."""
    count = lambda d, name: d.where(~F.col("is_deleted")).groupBy("book_id").agg(F.count(F.lit(1)).alias(name))
    b = books.where(~F.col("is_deleted")).join(count(highlights, "h"), "book_id", "left").join(count(thoughts, "t"), "book_id", "left")
    h, t = F.coalesce("h", F.lit(0)), F.coalesce("t", F.lit(0))
    return b.select(
        "book_id", "title", F.coalesce("author", F.lit("")).alias("author"), F.coalesce("category", F.lit("")).alias("category"),
        h.alias("highlight_count"), t.alias("thought_count"), F.when(F.col("finish_reading"), 100).otherwise(0).alias("progress"),
        when_text(F.col("read_update_time")).alias("updated_at"), reading_status(h, t).alias("reading_status"), F.col("read_update_time"),
    )


SORTS = {"highlights": [F.desc, "highlight_count"], "thoughts": [F.desc, "thought_count"], "title": [F.asc, "title"], "recent": [F.desc, "read_update_time"]}


def book_page(listed: DataFrame, query: str = "", category: str = "all", status: str = "all", with_highlights: bool = False, with_thoughts: bool = False, sort_by: str = "recent", limit: int | None = 50, offset: int = 0) -> DataFrame:
    """A page of ``book_list``; null-like arguments ('all', '') switch their predicate off, no limit gives all rows in no order."""
    if sort_by not in SORTS:
        raise ValueError(f"unknown sort: {sort_by}")
    if status not in ("all", "finished", "reading", "unread"):
        raise ValueError(f"unknown status: {status}")
    d = listed.where(like_any(query, "title", "author"))
    if category != "all":
        d = d.where(F.col("category") == category)
    if status != "all":
        d = d.where(F.col("reading_status") == status)
    if with_highlights or with_thoughts:
        d = d.where((F.lit(with_highlights) & (F.col("highlight_count") > 0)) | (F.lit(with_thoughts) & (F.col("thought_count") > 0)))
    if limit is None:
        return d
    way, column = SORTS[sort_by]
    key = F.lower(column) if sort_by == "title" else F.coalesce(F.col(column), F.lit(0))
    return d.orderBy(way(key), "book_id").offset(max(0, offset)).limit(min(500, max(1, limit)))


def page_with_facets(listed: DataFrame, facets: tuple[str, ...] = ("category", "reading_status"), **page) -> DataFrame:
    """``part, value, n, place``: the page's rows, how many there are in all, and how many of each value of the facets, in one result.

    ``page`` are the arguments of ``book_page``. Total and facets are grouping
    sets of one pass over the filtered rows, which are made once; a null value is shown as a blank one.
    """
    limit, offset = min(500, max(1, page.pop("limit", 50))), max(0, page.pop("offset", 0))
    found = settle(book_page(listed, limit=None, **page))
    sets = found.groupingSets([[F.col(c)] for c in facets] + [[]], *facets).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    which = {(1 << len(facets)) - 1 - (1 << (len(facets) - 1 - i)): c for i, c in enumerate(facets)}
    name = F.coalesce(*[F.when(F.col("g") == g, c) for g, c in which.items()], F.lit("total"))
    value = F.coalesce(*[F.when(F.col("g") == g, F.col(c).cast("string")) for g, c in which.items()], F.lit(""))
    nothing = found.sparkSession.range(1).select(F.lit("total").alias("part"), F.lit("").alias("value"), F.lit(0).cast("bigint").alias("n"))  # without rows there are no sets
    counts = sets.select(name.alias("part"), value.alias("value"), "n").union(nothing).groupBy("part", "value").agg(F.sum("n").alias("n"), F.lit(0).alias("place"))
    way, column = SORTS[page.get("sort_by", "recent")]
    key = F.lower(column) if column == "title" else F.coalesce(F.col(column), F.lit(0))
    rows = found.orderBy(way(key), "book_id").offset(offset).limit(limit)
    place = F.row_number().over(Window.orderBy(way(key), "book_id"))  # of one page
    return rows.select(F.lit("page").alias("part"), F.col("book_id").alias("value"), F.lit(1).cast("bigint").alias("n"), place.alias("place")).unionByName(counts)


def note_counts(books: DataFrame, highlights: DataFrame, thoughts: DataFrame) -> DataFrame:
    """One row of live counts; each table is reduced to a number before they meet."""
    one = lambda d, name: d.select(F.count_if(~F.col("is_deleted")).alias(name))
    return one(books, "books").crossJoin(one(highlights, "highlights")).crossJoin(one(thoughts, "thoughts"))  # one row each


def category_histogram(books: DataFrame, top: int = 8) -> DataFrame:
    d = books.where(~F.col("is_deleted")).groupBy(blank_bucket(F.col("category")).alias("label")).agg(F.count(F.lit(1)).alias("count"))
    return d.orderBy(F.desc("count"), "label").limit(top)


def browse(notes: DataFrame, books: DataFrame, query: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """Rows of the notes' table for browsing: notes stay if their book is missing."""
    d = notes.where(~F.col("is_deleted")).join(books.select("book_id", "title"), "book_id", "left")
    d = d.where(like_any(query, "content", "chapter", "title"))
    d = d.select(F.col("note_id").alias("id"), F.col("content").alias("primary"), F.coalesce("title", F.lit("")).alias("secondary"), F.coalesce("chapter", F.lit("")).alias("detail"), when_text(F.col("created")).alias("created_at"))
    return d.orderBy(F.desc("created_at"), "id").offset(max(0, offset)).limit(min(100, max(1, limit)))


#: Tables that may be browsed: what is searched, and the key, title, two details and the time that are shown (``t`` is the table, ``b`` its book).
BROWSED = {
    "books": (["title", "author", "book_id"], ["book_id", "title", "coalesce(author, '')", "coalesce(category, '')", "read_update_time"]),
    "highlights": (["mark_text", "chapter_title", "book_title"], ["bookmark_id", "mark_text", "coalesce(book_title, '')", "coalesce(chapter_title, '')", "create_time"]),
    "thoughts": (["content", "chapter_name", "book_title"], ["review_id", "content", "coalesce(book_title, '')", "coalesce(chapter_name, '')", "create_time"]),
    "sessions": (["source", "status", "error"], ["id", "status", "source", "concat_ws(' · ', concat('books ', books), concat('highlights ', highlights), concat('thoughts ', thoughts))", "started_at"]),
    "metadata": (["book_title", "source", "publisher", "authors", "book_id"], ["book_id", "coalesce(book_title, title, book_id)", "source", "coalesce(nullif(publisher, ''), authors, '')", "fetched_at"]),
    "terms": (["term", "canonical_name", "definition"], ["CAST(id AS string)", "term", "canonical_name", "substring(definition, 1, 200)", "updated_at"]),
}


def browse_table(name: str, rows: DataFrame, books: DataFrame, query: str = "", limit: int = 50, offset: int = 0) -> DataFrame:
    """``id, primary, secondary, detail, created_at, total``: a page of one of the BROWSED tables, newest first, and how many rows match in all.

    Other tables are an error. Deleted rows are left out; a row stays if its
    book is missing. A page has 1 to 100 rows.
    """
    if name not in BROWSED:
        raise ValueError(f"no table to browse: {name}")
    searched, shown = BROWSED[name]
    d = rows.where("NOT coalesce(is_deleted, false)") if "is_deleted" in rows.columns else rows
    if "book_title" in searched:
        d = d.join(books.select("book_id", F.col("title").alias("book_title")), "book_id", "left")
    d = d.where(like_any(query, *searched))
    found = d.select(*[F.expr(x).alias(c) for x, c in zip(shown, ("id", "primary", "secondary", "detail", "at"), strict=True)])
    total = found.agg(F.count(F.lit(1)).alias("total"))
    page = found.orderBy(F.desc_nulls_last("at"), "id").offset(max(0, offset)).limit(min(100, max(1, limit)))
    return page.crossJoin(F.broadcast(total)).select("id", "primary", "secondary", "detail", when_text(F.col("at")).alias("created_at"), "total")  # one row


def merge_upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old_if_null: bool = True) -> DataFrame:
    """``old`` with the rows of ``new`` put in: by key, the new value where there is one."""
    rest = [c for c in old.columns if c not in keys]
    n = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in rest if c in new.columns], F.lit(True).alias("new_row"))
    pick = lambda c: F.coalesce(F.col(f"new_{c}"), F.col(c)) if keep_old_if_null else F.when(F.col("new_row"), F.col(f"new_{c}")).otherwise(F.col(c))
    return old.join(n, keys, "full_outer").select(*keys, *[(pick(c) if c in new.columns else F.col(c)).alias(c) for c in rest])


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in ``order``."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def top_per_group(rows: DataFrame, group: str, n: int, *order: Column) -> DataFrame:
    """The first n rows of each group; Spark limits each task's groups before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= n)


def mark_sweep(stored: DataFrame, seen: DataFrame, key: str, exempt_books: DataFrame | None = None) -> DataFrame:
    """After a complete pass, rows that were not seen are deleted, but not those of exempt books."""
    s = stored.join(seen.select(key, F.lit(True).alias("seen")).distinct(), key, "left")
    if exempt_books is not None:
        s = s.join(exempt_books.select("book_id", F.lit(True).alias("exempt")).distinct(), "book_id", "left")
    else:
        s = s.withColumn("exempt", F.lit(None).cast("boolean"))
    gone = F.col("seen").isNull() & F.col("exempt").isNull()
    return s.withColumn("is_deleted", F.col("is_deleted") | gone).drop("seen", "exempt")


def flatten_nested(rows: DataFrame, nested: str, fields: list[str], numbers: list[str]) -> DataFrame:
    """Fields that are null at the top are taken from the struct ``nested``; number fields that are texts become numbers, what is none stays null."""
    inner = rows.schema[nested].dataType.fieldNames()
    value = lambda c: F.coalesce(F.col(c), F.col(f"{nested}.{c}")) if c in inner else F.col(c)
    return rows.select(*[c for c in rows.columns if c not in fields and c != nested], *[(value(c).try_cast("double") if c in numbers else value(c)).alias(c) for c in fields])


def with_metadata(books: DataFrame, metadata: DataFrame, source: str) -> DataFrame:
    """Live books with the metadata of one source and the names and time of all: a book without any is ``missing``."""
    one = metadata.where(F.col("source") == source).select("book_id", "isbn", "subjects")
    every = metadata.groupBy("book_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("source"))).alias("sources"), F.max("fetched_at").alias("fetched_at"))
    j = books.where(~F.col("is_deleted")).join(one, "book_id", "left").join(every, "book_id", "left")
    return j.select("book_id", F.coalesce("isbn", F.lit("")).alias("isbn"), F.coalesce("sources", F.lit("")).alias("sources"), "fetched_at", F.when(F.col("fetched_at").isNull(), "missing").otherwise("ready").alias("state"))


def by_priority(rows: DataFrame, key: str, column: str, priority: list[str]) -> DataFrame:
    """The row of each key whose ``column`` stands first in ``priority``; others come last, by name."""
    at = F.array_position(F.array(*[F.lit(x) for x in priority]), F.col(column))
    return latest(rows, [key], F.when(at == 0, len(priority) + 1).otherwise(at).asc(), F.col(column).asc())


def keep_detail(old: DataFrame, new: DataFrame, key: list[str], lists: list[str]) -> DataFrame:
    """Upsert of metadata: null and, for ``lists``, empty arrays don't overwrite what is stored."""
    n = new.select(*[F.when(F.size(c) > 0, F.col(c)).alias(c) if c in lists else F.col(c) for c in new.columns])
    return merge_upsert(old, n, key)


def merge_recommendation(detail: DataFrame, hit: DataFrame, key: str, override: list[str]) -> DataFrame:
    """``detail`` with what it lacks from ``hit``; the ``override`` columns are the hit's where it has them."""
    rest = [c for c in detail.columns if c != key]
    h = hit.select(key, *[F.col(c).alias(f"h_{c}") for c in rest if c in hit.columns])
    pick = lambda c: F.coalesce(f"h_{c}", c) if c in override else F.coalesce(c, f"h_{c}")
    return detail.join(h, key, "left").select(key, *[(pick(c) if c in hit.columns else F.col(c)).alias(c) for c in rest])


def append_new(shown: DataFrame, page: DataFrame, key: str) -> DataFrame:
    """``shown``, then the rows of the next page that it lacks."""
    return shown.unionByName(page.join(shown.select(key), key, "left_anti"))
