"""Search over books, notes and imported sources, and what a prompt is made of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import core_title, normalize_search, snippet, when_text
from . import retrieval as R
from .search_index import SearchIndex

TYPES = ("book", "highlight", "thought", "source")
#: Most rows of a page, largest offset, fewest and most candidates of a kind.
MOST_ROWS, MOST_OFFSET, LEAST_CANDIDATES, MOST_CANDIDATES = 200, 5000, 30, 500
RESULT = ("id", "entity_type", "book_id", "title", "subtitle", "snippet", "score", "updated_at")


def checked_types(types: list[str] | None) -> list[str]:
    """The kinds asked for, all if none; an error for an unknown one."""
    unknown = set(types or ()) - set(TYPES)
    if unknown:
        raise ValueError(f"unknown kinds: {sorted(unknown)}")
    return list(types or TYPES)


def subtitle() -> Column:
    part = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.concat_ws(" · ", part("author"), part("category"))


def _notes(notes: DataFrame, types: list[str], book_id: str | None) -> DataFrame:
    rows = notes.where(F.col("note_type").isin(types))
    return rows.where(F.col("book_id") == book_id) if book_id else rows


def _as_results(notes: DataFrame | None, books: DataFrame | None, sources: DataFrame | None) -> DataFrame | None:
    """The three kinds in one shape; their rows have a score."""
    parts = []
    if notes is not None:
        parts.append(notes.select(F.col("note_id").alias("id"), F.col("note_type").alias("entity_type"), "book_id", "title", F.coalesce("chapter", F.lit("")).alias("subtitle"), snippet(F.col("content")).alias("snippet"), "score", when_text(F.col("created")).alias("updated_at")))
    if books is not None:
        number = F.when(F.coalesce("isbn", F.lit("")) != "", F.concat(F.lit("ISBN "), "isbn")).otherwise("")
        parts.append(books.select(F.col("book_id").alias("id"), F.lit("book").alias("entity_type"), "book_id", "title", subtitle().alias("subtitle"), number.alias("snippet"), "score", when_text(F.col("updated")).alias("updated_at")))
    if sources is not None:
        parts.append(sources.select("id", F.lit("source").alias("entity_type"), F.lit("").alias("book_id"), "title", F.coalesce("heading", F.lit("")).alias("subtitle"), snippet(F.col("content")).alias("snippet"), "score", when_text(F.col("updated")).alias("updated_at")))
    return reduce(DataFrame.unionByName, parts) if parts else None


def recent(notes: DataFrame, books: DataFrame, sources: DataFrame, types: list[str] | None = None, book_id: str | None = None, limit: int = 30, offset: int = 0) -> DataFrame:
    """The newest of each kind, then of all: what a blank query shows."""
    kinds, score, n = checked_types(types), F.lit(0.0), limit + offset + 1
    top = lambda d, at, key: d.orderBy(F.desc(at), key).limit(n).withColumn("score", score)
    note_kinds = [k for k in kinds if k in ("highlight", "thought")]
    some = [top(_notes(notes, [k], book_id), "created", "note_id") for k in note_kinds]
    found = _as_results(
        reduce(DataFrame.unionByName, some) if some else None,
        top(books.where(F.col("book_id") == book_id) if book_id else books, "updated", "book_id") if "book" in kinds else None,
        top(sources, "updated", "id") if "source" in kinds and not book_id else None,
    )
    return found.orderBy(F.desc("updated_at"), "title", "id").offset(offset).limit(limit).select(*RESULT)


def global_search(notes: DataFrame, books: DataFrame, sources: DataFrame, indexes: dict[str, SearchIndex], query: str, types: list[str] | None = None, book_id: str | None = None, limit: int = 30, offset: int = 0) -> DataFrame:
    """A page of books, notes and sources, best first; scores are shares of the best one's.

    Each kind brings its candidates from its index (``indexes`` has those of
    ``notes``, ``books`` and ``sources``), or its first rows if nothing matches,
    and its own rule score; what scores nothing goes. A filter by book leaves
    sources out. A blank query shows what is newest.
    """
    kinds, limit, offset = checked_types(types), min(MOST_ROWS, max(1, limit)), min(MOST_OFFSET, max(0, offset))
    if not query.strip():
        return recent(notes, books, sources, kinds, book_id, limit, offset)
    terms, most = R.search_terms(query), min(MOST_CANDIDATES, max(LEAST_CANDIDATES, 3 * (limit + offset)))
    found_notes = found_books = found_sources = None
    note_kinds = [k for k in kinds if k in ("highlight", "thought")]
    if note_kinds:
        some = len(note_kinds) < 2 or book_id
        only = _notes(notes, note_kinds, book_id).select(F.col("note_id").alias("id")) if some else None
        c = R.candidates(notes, indexes["notes"], "note_id", query, most, most, only)
        found_notes = R.normalized(c, "title", "chapter", "content").withColumn("score", R.score_candidate(query, terms, "_content", ("_title", 5.0), ("_chapter", 3.0)))
    if "source" in kinds and not book_id:
        c = R.candidates(sources, indexes["sources"], "id", query, most, most)
        found_sources = R.normalized(c, "title", "heading", "content").withColumn("score", R.score_candidate(query, terms, "_content", ("_title", 4.0), ("_heading", 2.5)))
    if "book" in kinds:
        only = books.where(F.col("book_id") == book_id).select(F.col("book_id").alias("id")) if book_id else None
        c = R.candidates(books, indexes["books"], "book_id", query, most, most, only)
        found_books = R.normalized(c, "title", "author", "category").withColumn("score", F.col("relevance") + R.book_boost(query))
    found = _as_results(found_notes, found_books, found_sources)
    top = found.orderBy(F.desc("score"), F.desc("updated_at"), "id").limit(offset + limit)  # the best one is on the first page
    best = R.peak_normalize(top, "score", "raw")
    return best.where("raw > 0").orderBy(F.desc("raw"), F.desc("updated_at"), "id").offset(offset).limit(limit).select(*RESULT)


def quota(books: int) -> int:
    """Notes of each book in an answer about several: 5 for up to 12 books, 3 for up to 30, else 1."""
    return 5 if books <= 12 else 3 if books <= 30 else 1


def rag_search(notes: DataFrame, index: SearchIndex, question: str, mode: str, book_ids: list[str]) -> DataFrame:
    """Notes for an answer: 200 of one book or of all, else a quota for each book, so that none is left out.

    Modes other than ``ask`` search for nothing in particular. Candidates are
    those of all notes, once; each of the books then takes its best. A book of
    which no note is among them has none.
    """
    query = question if mode == "ask" else ""
    if len(book_ids) <= 1:
        return R.hybrid_search(notes, index, query, 200, book_ids=book_ids)
    if query.strip():
        scored = R.hybrid_scores(notes, index, query)
    else:
        scored = notes.select("note_id", "note_type", "book_id", "title", "chapter", F.lit(1.0).alias("score"))
    by_book = Window.partitionBy("book_id").orderBy(F.desc("score"), "note_id")
    ranked = scored.where(F.col("book_id").isin(book_ids)).withColumn("rn", F.row_number().over(by_book))
    return ranked.where((F.col("rn") <= quota(len(book_ids))) & (F.col("score") > 0)).drop("rn")


def like_any_term(rows: DataFrame, terms: list[str], most: int, id_col: str, *columns: str) -> DataFrame:
    """Rows of which a column has one of the terms, ASCII letters of either case; the first ``most`` by id. No terms, no rows."""
    some = [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(t)) for t in terms for c in columns]
    return rows.where(reduce(Column.__or__, some, F.lit(False))).orderBy(id_col).limit(most)


def source_evidence(sources: DataFrame, index: SearchIndex, question: str, book_ids: list[str], mode: str = "ask") -> DataFrame:
    """Passages of imported sources: 12 for a question, else 6; none if books are chosen or nothing is asked.

    Candidates match by word, or contain a term if none does; ``score_block`` ranks them.
    """
    limit, terms = 12 if mode == "ask" else 6, R.search_terms(question)
    if book_ids or not terms:
        return sources.limit(0).select("id", "title", "content", F.lit(0.0).alias("score"))
    most = min(5000, max(200, 8 * limit))
    scored = index.match(R.match_terms(question), most)
    if scored is not None:
        found = sources.join(F.broadcast(scored.select("id")), "id")
    else:
        found = like_any_term(sources, terms, most, "id", "content", "heading", "title")
    found = found.select("id", "title", "content", R.score_block(question, terms, "content").cast("double").alias("score"))
    return found.orderBy(F.desc("score"), "id").limit(limit).where("score > 0")


def note_chars(mode: Column, results: Column, books: Column) -> Column:
    """How many characters of each note a prompt takes."""
    ask = F.when(results > 100, 220).when(results > 30, 700).otherwise(1200)
    return F.when(mode == "ask", ask).when(mode == "compare", F.when(books > 30, 420).otherwise(700)).otherwise(1200)


def prompt_lines(evidence: DataFrame, most: Column, *order: Column) -> DataFrame:
    """``n, line``: the evidence numbered in ``order``, one text each; the evidence of one prompt, so few rows."""
    n = F.row_number().over(Window.orderBy(*order))
    body = F.substring(F.trim(F.coalesce("content", F.lit(""))), F.lit(1), most)
    return evidence.select(n.alias("n"), F.concat(F.lit("["), n.cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.when(F.coalesce("chapter", F.lit("")) != "", F.concat(F.lit(" / "), "chapter")).otherwise(""), F.lit("\n"), body).alias("line"))


def locator_label(page: Column, chapter: Column, kind: Column, heading: Column) -> Column:
    """Where a passage stands: its page, else its chapter, else the web page, else its heading."""
    return F.when(page.isNotNull(), F.concat(F.lit("p. "), page.cast("string"))).when(chapter.isNotNull(), F.concat(F.lit("ch. "), chapter.cast("string"))).when(kind == "web", "web page").otherwise(F.coalesce(heading, F.lit("")))


def cited(evidence: DataFrame, answer: str, mark: str = "") -> DataFrame:
    """The numbered evidence that the answer names as ``[n]``, or ``[Wn]`` with a mark."""
    return evidence.where(F.contains(F.lit(answer), F.concat(F.lit("[" + mark), F.col("n").cast("string"), F.lit("]"))))


def metadata_context(metadata: DataFrame, book_ids: list[str], priority: list[str], most: int = 20, intro: int = 600) -> DataFrame:
    """``book_id, source, line`` of the first ``most`` books, sources in ``priority`` order, others left out."""
    first = metadata.where(F.col("book_id").isin(book_ids[:most]) & F.col("source").isin(priority))
    list_ = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), ", ")
    line = F.concat_ws("\n", F.concat(F.lit("source: "), "source"), F.concat(F.lit("title: "), "title"), F.concat(F.lit("authors: "), list_("authors")), F.concat(F.lit("subjects: "), list_("subjects")), F.concat(F.lit("intro: "), F.substring(F.coalesce("description", F.lit("")), 1, intro)))
    rank = F.array_position(F.array(*[F.lit(x) for x in priority]), F.col("source"))
    return first.select("book_id", "source", rank.cast("int").alias("rank"), line.alias("line"))


def fuzzy_best(wanted: DataFrame, found: DataFrame, by: str = "authors") -> DataFrame:
    """For each ``id, title, author`` of ``wanted`` the best of ``found`` (``id, key, title, author``), the last ``key`` of equal ones.

    Core titles, letters and digits only: equal 100, one within the other 60.
    By ``authors``: 20 more if one author has the other; a blank title is within
    none, and an answer that only shares the author counts. By ``abstract``
    (``author`` of ``found`` is a text): 30 more if it names the author; the
    best one goes if its title has nothing of the wanted one.
    """
    plain = lambda c: normalize_search(core_title(F.coalesce(c, F.lit(""))))
    name = lambda c: normalize_search(F.coalesce(c, F.lit("")))
    f = found.select("id", "key", plain(F.col("title")).alias("t2"), name(F.col("author")).alias("a2"))
    j = wanted.select("id", plain(F.col("title")).alias("t1"), name(F.col("author")).alias("a1")).join(f, "id")
    t1, t2, a1, a2 = (F.col(c) for c in ("t1", "t2", "a1", "a2"))
    near = F.contains(t1, t2) | F.contains(t2, t1)
    if by == "authors":
        score = F.when(t1 == t2, 100).when((t1 != "") & near, 60).otherwise(0) + F.when((a1 != "") & (F.contains(a1, a2) | F.contains(a2, a1)), 20).otherwise(0)
        told = score > 0
    else:
        score = F.when(t1 == t2, 100).when(near, 60).otherwise(0) + F.when((a1 != "") & F.contains(a2, a1), 30).otherwise(0)
        told = near
    best = j.groupBy("id").agg(F.max_by(F.struct("key", score.alias("score"), told.alias("told")), F.struct(score, F.col("key"))).alias("x"))
    return best.where("x.told").select("id", "x.key", "x.score")
