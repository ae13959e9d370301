"""Text retrieval: terms, inverted index, BM25 candidates, rule scores, diversity."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import char_pairs, normalize_search, occurrences
from .search_index import SearchIndex, fold, words


#: Characters of text whose words one task counts.
TASK_CHARS = 8_000_000
#: Names of one dynasty; a query with one of the first three is searched for all.
DYNASTY = ["清朝", "清代", "清史", "大清", "满清"]


def _norm(text: str) -> str:
    return re.sub(r"[\W_]", "", text.lower())


def search_terms(query: str) -> list[str]:
    """Normalised words, the bigrams of the whole query and the dynasty's names, longest first."""
    whole = _norm(query)
    found = {w for w in map(_norm, query.split()) if w} | {whole[i : i + 2] for i in range(len(whole) - 1)}
    if any(x in whole for x in DYNASTY[:3]):
        found |= set(DYNASTY)
    return sorted(found, key=lambda t: (-len(t), t))


def terms_of(query: Column) -> Column:
    """``search_terms`` of a column of queries."""
    whole = normalize_search(query)
    words = F.filter(F.transform(F.split(query, r"\s+"), normalize_search), lambda w: w != "")
    pairs = F.when(F.char_length(whole) >= 2, F.array_distinct(F.concat(words, char_pairs(whole)))).otherwise(F.array_distinct(words))
    dynasty = reduce(Column.__or__, [F.contains(whole, F.lit(x)) for x in DYNASTY[:3]])
    every = F.when(dynasty, F.array_union(pairs, F.array(*map(F.lit, DYNASTY)))).otherwise(pairs)
    return F.transform(F.array_sort(F.transform(every, lambda t: F.struct((-F.char_length(t)).alias("n"), t.alias("t")))), lambda x: x["t"])


def match_terms(query: str, most: int = 12) -> list[str]:
    """The terms that candidates are matched by: the longest ones, without marks; none for a query of symbols only."""
    return list(dict.fromkeys(map(fold, search_terms(query)[:most])))


def all_terms(text: Column, query: str) -> Column:
    """Whether the text has every word of the query."""
    words = [w for w in map(_norm, query.split()) if w]
    return reduce(Column.__and__, [F.contains(normalize_search(text), F.lit(w)) for w in words], F.lit(bool(words)))


def postings(docs: DataFrame, id_col: str, *fields: str) -> DataFrame:
    """``id, field, term, tf``: the inverted index of each field's words, in lower case without marks.

    Texts are dealt by id once; each document's words are then counted where
    they are, which moves less than dealing out the words. A task gets about
    TASK_CHARS of text, however much there is in all.
    """
    chars = docs.agg(F.sum(reduce(Column.__add__, [F.coalesce(F.char_length(F.col(f).cast("string")), F.lit(0)) for f in fields]))).first()[0] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // TASK_CHARS))
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), words(f).alias("w")) for f in fields]))
    dealt = docs.select(F.col(id_col).alias("id"), *fields).repartition(tasks, "id")
    found = dealt.select("id", each.alias("x")).select("id", "x.field", F.explode("x.w").alias("term"))
    return found.groupBy("id", "field", "term").agg(F.count(F.lit(1)).alias("tf"))


def candidates(docs: DataFrame, index: SearchIndex, id_col: str, query: str, matched: int, scanned: int, only: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` to be scored, with their ``relevance``: the ``matched`` best of the index by BM25.

    If the query has no terms or no document has one, the first ``scanned`` rows
    by id. ``only`` (``id``) restricts both.
    """
    found = index.match(match_terms(query), matched, only)
    if found is not None and (only is None or not found.isEmpty()):
        ids = found.select(F.col("id").alias(id_col), F.col("score").alias("relevance"))
        return docs.join(F.broadcast(ids), id_col)  # ``matched`` rows at most
    rows = docs if only is None else docs.join(only.select(F.col("id").alias(id_col)), id_col, "left_semi")
    return rows.orderBy(id_col).limit(scanned).withColumn("relevance", F.lit(0.0))


def has_term(terms: list[str], *fields: str) -> Column:
    """Whether any of the terms is a word of a field."""
    return F.arrays_overlap(words(*fields), F.array(*map(F.lit, terms))) if terms else F.lit(False)


def normalized(rows: DataFrame, *columns: str) -> DataFrame:
    """``_column`` beside each column: its letters and numbers in lower case, made once for all terms."""
    return rows.withColumns({f"_{c}": normalize_search(F.coalesce(F.col(c), F.lit(""))) for c in columns})


def rule_score(terms: list[str], content: str, *fields: tuple[str, float]) -> Column:
    """For each term the weight of every field that has it, and its occurrences in the content, 4 at most; columns are normalised."""
    has = lambda c, t, w: F.when(F.contains(F.col(c), F.lit(t)), w).otherwise(0.0)
    return reduce(Column.__add__, [reduce(Column.__add__, [has(c, t, w) for c, w in fields], occurrences(F.col(content), t)) for t in terms], F.lit(0.0))


def score_hybrid(query: str, terms: list[str]) -> Column:
    """On ``normalized`` title, chapter and content. Whole query in the content 12; for each term title 5, chapter 3 and occurrences; a blank query 1."""
    whole = _norm(query)
    if not whole:
        return F.lit(1.0)
    return F.when(F.contains("_content", F.lit(whole)), 12.0).otherwise(0.0) + rule_score(terms, "_content", ("_title", 5.0), ("_chapter", 3.0))


def score_candidate(query: str, terms: list[str], content: str, *fields: tuple[str, float]) -> Column:
    """Relevance + content match (whole 12, any term 4, else 0 in all) + ``rule_score``, on normalised columns."""
    some = reduce(Column.__or__, [F.contains(F.col(content), F.lit(t)) for t in terms], F.lit(False))
    base = F.when(F.contains(F.col(content), F.lit(_norm(query))), 12.0).when(some, 4.0)
    return F.coalesce(F.col("relevance") + base + rule_score(terms, content, *fields), F.lit(0.0))


def book_boost(query: str) -> Column:
    """On normalised title, author and category: equal 3, beginning 2, else title 1, author .8, category .4, isbn 2.5 where they have the query."""
    whole = F.lit(_norm(query))
    has = lambda c, w: F.when(F.contains(F.col(c), whole), w).otherwise(0.0)
    other = has("_title", 1.0) + has("_author", 0.8) + has("_category", 0.4) + F.when(F.contains(F.coalesce("isbn", F.lit("")), whole), 2.5).otherwise(0.0)
    return F.when(F.col("_title") == whole, 3.0).when(F.startswith("_title", whole), 2.0).otherwise(other)


def score_block(query: str, terms: list[str], content: str) -> Column:
    """Whole query: 12 and the occurrences; else the occurrences and 4; else 0."""
    x = normalize_search(F.coalesce(F.col(content), F.lit("")))
    whole = _norm(query)
    occ = reduce(Column.__add__, [occurrences(x, t) for t in terms])
    return F.when(F.contains(x, F.lit(whole)), 12.0 + occ).when(occ > 0, 4.0 + occ).otherwise(0.0)


def diverse(rows: DataFrame, group: str, per_group: int, limit: int, *order: Column, only: str = "true") -> DataFrame:
    """The first ``per_group`` of each group in rank order, then what is over, up to ``limit``.

    ``only`` is a condition that rows fulfil before others in the order; asked
    after ranking, it isn't evaluated again below.
    """
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.where(only).orderBy(F.col("_rn") > per_group, *order).limit(limit).drop("_rn")


def hybrid_scores(notes: DataFrame, index: SearchIndex, query: str, most: int = 5000, scanned: int = 800, kind: str | None = None) -> DataFrame:
    """``note_id, note_type, book_id, title, chapter, score`` of the candidates among all notes that score anything."""
    rows = notes.where(F.col("note_type") == kind) if kind else notes
    only = rows.select(F.col("note_id").alias("id")) if kind else None
    found = candidates(rows, index, "note_id", query, most, scanned, only)
    scored = normalized(found, "title", "chapter", "content").withColumn("score", score_hybrid(query, search_terms(query)))
    return scored.select("note_id", "note_type", "book_id", "title", "chapter", "score")


def hybrid_search(notes: DataFrame, index: SearchIndex, query: str, limit: int = 50, most: int = 5000, per_book: int = 8, scanned: int = 800, book_ids: list[str] | None = None, kind: str | None = None) -> DataFrame:
    """Notes for a query: candidates of the whole index, rule score, at most ``per_book`` of a book first unless books are given.

    The books choose among the candidates, after these are taken from all notes.
    A blank query gives the first notes by id, of the first book if any is given.
    """
    order = (F.desc("score"), F.asc("note_id"))
    if not query.strip():
        rows = notes.where(F.col("note_type") == kind) if kind else notes
        rows = rows.where(F.col("book_id") == book_ids[0]) if book_ids else rows
        scored = rows.orderBy("note_id").limit(limit).select("note_id", "note_type", "book_id", "title", "chapter", F.lit(1.0).alias("score"))
    else:
        scored = hybrid_scores(notes, index, query, most, scanned, kind)
        scored = scored.where(F.col("book_id").isin(book_ids)) if book_ids else scored
    if limit > 20 and not book_ids:
        return diverse(scored, "book_id", per_book, limit, *order, only="score > 0")
    return scored.orderBy(*order).limit(limit).where("score > 0")


def combined(lexical: Column, semantic: Column, rerank: Column | None = None) -> Column:
    """Scores that ``peak_normalize`` made shares: rerank .85, lexical .10, semantic .05; without rerank .70 and .30."""
    if rerank is None:
        return 0.70 * lexical + 0.30 * semantic
    return 0.85 * rerank + 0.10 * lexical + 0.05 * semantic


def peak_normalize(rows: DataFrame, column: str, keep_as: str | None = None) -> DataFrame:
    """``column`` over its maximum, 0 to 1, the old value ``keep_as``. The maximum is one broadcast row, so rows stay where they are."""
    peak = rows.agg(F.max(column).alias("_peak"))
    x = F.when(F.col("_peak") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(column) / F.col("_peak")))).otherwise(0.0)
    both = rows.crossJoin(F.broadcast(peak))
    both = both.withColumn(keep_as, F.col(column)) if keep_as else both
    return both.withColumn(column, x).drop("_peak")


def dedup_evidence(rows: DataFrame, owner: str, target: str, content: str, *order: Column) -> DataFrame:
    """The first row of each owner, target and first 80 characters."""
    key = Window.partitionBy(owner, target, F.substring(F.trim(content), 1, 80)).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(key)).where("_rn = 1").drop("_rn")


def history_tail(turns: DataFrame, last: int = 8, most: int = 1200) -> DataFrame:
    """The last turns of each conversation in order, their text cut."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    t = turns.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= last)
    return t.select("conv_id", "turn", "role", F.substring("text", 1, most).alias("text"))
