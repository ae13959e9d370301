"""Queries of search, prompts, reranking and the glossary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import glossary as Y
from ..operators import rerank as K
from ..operators import retrieval as R
from ..operators import search as S
from ..sources import views as V
from .catalog import query

QUESTION = "the book en"
TERMS = R.search_terms(QUESTION)
WHOLE = "thebooken"

#: Views that the SQL of this module adds to BASE.
MORE = """,
sbooks AS (SELECT book_id, title, author, category, CASE WHEN n % 3 = 0 THEN '978' || lpad(n::VARCHAR, 10, '0') ELSE '' END AS isbn, coalesce(read_update_time, 0) AS updated FROM (SELECT *, CAST(substring(book_id, 4) AS BIGINT) AS n FROM books WHERE NOT is_deleted)),
srcs AS (SELECT 'w' || page_id AS id, url AS title, CASE WHEN page_id % 3 = 0 THEN 'Section ' || (page_id % 7) ELSE '' END AS heading, regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g') AS content, 1700000000 + page_id * 30 AS updated FROM pages WHERE page_id % 23 <> 0),
terms AS (SELECT item_id AS id, split_part(text, ' ', 1) AS term, CASE WHEN item_id % 3 = 0 THEN '' ELSE split_part(text, ' ', 2) END AS canonical_name, [split_part(text, ' ', 3), 'alias' || item_id] AS aliases, text AS definition,
  CASE WHEN item_id % 4 = 0 THEN 'encyclopedia' ELSE 'manual' END AS source, CASE item_id % 5 WHEN 0 THEN 'ignored' WHEN 1 THEN 'pending' ELSE 'confirmed' END AS status, item_id % 7 = 0 AS manually_edited, 1700000000 + (item_id * 37) % 1000 AS updated_at FROM benchmark)
"""


def _plain(c: str) -> str:
    return f"regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def _candidates(name: str, table: str, key: str, fields: list[str], terms: list[str], limit: int) -> str:
    """Common table expressions that end in ``name``: the best ``limit`` rows with their relevance."""
    text = "concat_ws(' ', " + ", ".join(f"coalesce({c}, '')" for c in fields) + ")"
    tf = ", ".join(f"len(list_filter(w, lambda t: t = '{x}')) AS tf{i}" for i, x in enumerate(terms))
    stat = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    some = " OR ".join(f"tf{i} > 0" for i in range(len(terms)))
    bm = " + ".join(f"ln(1 + (sn - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / mean))" for i in range(len(terms)))
    return f"""{name}_w AS (SELECT *, regexp_extract_all(strip_accents(lower({text})), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table}),
{name}_f AS (SELECT * EXCLUDE (w), len(w) AS dl, {tf} FROM {name}_w),
{name}_s AS (SELECT count(*) AS sn, avg(dl) AS mean, {stat} FROM {name}_f),
{name} AS (SELECT f.*, {bm} AS relevance FROM {name}_f f, {name}_s WHERE {some} ORDER BY relevance DESC, {key} LIMIT {limit})"""


def _rule(terms: list[str], content: str, *fields: tuple[str, float]) -> str:
    return " + ".join([f"least(4, (length({content}) - length(replace({content}, '{t}', ''))) // {len(t)})" + "".join(f" + CASE WHEN contains({c}, '{t}') THEN {w} ELSE 0.0 END" for c, w in fields) for t in terms])


def _candidate_score(terms: list[str], whole: str, *fields: tuple[str, float]) -> str:
    some = " OR ".join(f"contains(x, '{t}')" for t in terms)
    return f"CASE WHEN contains(x, '{whole}') THEN relevance + 12.0 + {_rule(terms, 'x', *fields)} WHEN {some} THEN relevance + 4.0 + {_rule(terms, 'x', *fields)} ELSE 0.0 END"


SNIPPET = "CASE WHEN length(trim(content)) > 160 THEN substring(trim(content), 1, 160) || '…' ELSE trim(content) END"
WHEN = "strftime(make_timestamp({} * 1000000), '%Y-%m-%d %H:%M:%S')"
BOOST = f"CASE WHEN xt = '{WHOLE}' THEN 3.0 WHEN starts_with(xt, '{WHOLE}') THEN 2.0 ELSE CASE WHEN contains(xt, '{WHOLE}') THEN 1.0 ELSE 0.0 END + CASE WHEN contains(xa, '{WHOLE}') THEN 0.8 ELSE 0.0 END + CASE WHEN contains(xk, '{WHOLE}') THEN 0.4 ELSE 0.0 END + CASE WHEN contains(isbn, '{WHOLE}') THEN 2.5 ELSE 0.0 END END"

GLOBAL = (
    MORE + ", " + _candidates("cn", "notes", "note_id", ["title", "chapter", "content"], R.match_terms(QUESTION), 105) + ", " + _candidates("cs", "srcs", "id", ["title", "heading", "content"], R.match_terms(QUESTION), 105) + ", "
    + _candidates("cb", "sbooks", "book_id", ["title", "author", "category", "isbn"], R.match_terms(QUESTION), 105)
    + f""", allof AS (
SELECT note_id AS id, note_type AS entity_type, book_id, title, coalesce(chapter, '') AS subtitle, {SNIPPET} AS snippet, {_candidate_score(TERMS, WHOLE, ("xt", 5.0), ("xh", 3.0))} AS raw, {WHEN.format('created')} AS updated_at FROM (SELECT *, {_plain('content')} AS x, {_plain('title')} AS xt, {_plain('chapter')} AS xh FROM cn)
UNION ALL SELECT id, 'source', '', title, heading, {SNIPPET}, {_candidate_score(TERMS, WHOLE, ("xt", 4.0), ("xh", 2.5))}, {WHEN.format('updated')} FROM (SELECT *, {_plain('content')} AS x, {_plain('title')} AS xt, {_plain('heading')} AS xh FROM cs)
UNION ALL SELECT book_id, 'book', book_id, title, concat_ws(' · ', nullif(trim(author), ''), nullif(trim(category), '')), CASE WHEN isbn <> '' THEN 'ISBN ' || isbn ELSE '' END, relevance + {BOOST}, {WHEN.format('updated')} FROM (SELECT *, {_plain('title')} AS xt, {_plain('author')} AS xa, {_plain('category')} AS xk FROM cb))
SELECT id, entity_type, book_id, title, subtitle, snippet, round(least(1, raw / (SELECT max(raw) FROM allof)), 9) AS score, updated_at FROM (SELECT * FROM allof WHERE raw > 0 ORDER BY raw DESC, updated_at DESC, id LIMIT 30 OFFSET 5)"""
)


@query("t_global_search", GLOBAL)
def _(s, d):
    return S.global_search(V.notes(s, d), V.search_books(s, d), V.sources(s, d), V.indexes(s, d), QUESTION, limit=30, offset=5).withColumn("score", F.round("score", 9))


@query("t_score_book", MORE + ", " + _candidates("cb", "sbooks", "book_id", ["title", "author", "category", "isbn"], R.match_terms("book src1"), 500) + f", z AS (SELECT book_id, relevance + {BOOST.replace(WHOLE, 'booksrc1')} AS score FROM (SELECT *, {_plain('title')} AS xt, {_plain('author')} AS xa, {_plain('category')} AS xk FROM cb)) SELECT book_id, round(score, 9) AS score FROM z")
def _(s, d):
    c = R.candidates(V.search_books(s, d), V.index(s, d, "books"), "book_id", "book src1", 500, 500)
    return R.normalized(c, "title", "author", "category").select("book_id", F.round(F.col("relevance") + R.book_boost("book src1"), 9).alias("score"))


@query("t_score_source", MORE + ", " + _candidates("cs", "srcs", "id", ["title", "heading", "content"], R.match_terms("the section"), 500) + f" SELECT id, round({_candidate_score(R.search_terms('the section'), 'thesection', ('xt', 4.0), ('xh', 2.5))}, 9) AS score FROM (SELECT *, {_plain('content')} AS x, {_plain('title')} AS xt, {_plain('heading')} AS xh FROM cs)")
def _(s, d):
    c = R.candidates(V.sources(s, d), V.index(s, d, "sources"), "id", "the section", 500, 500)
    return R.normalized(c, "title", "heading", "content").select("id", F.round(R.score_candidate("the section", R.search_terms("the section"), "_content", ("_title", 4.0), ("_heading", 2.5)), 9).alias("score"))


@query("j_fts_doc", MORE + ", " + _candidates("cs", "srcs", "id", ["title", "heading", "content"], ["the"], 40) + " SELECT id, title, heading, round(relevance, 9) AS relevance FROM cs")
def _(s, d):
    src = V.sources(s, d)
    return src.join(F.broadcast(V.index(s, d, "sources").match(["the"], 40)), "id").select("id", "title", "heading", F.round("score", 9).alias("relevance"))


BOOKS = [f"src{i}" for i in range(1, 15)]
QUOTA = ", ".join(f"'{b}'" for b in BOOKS)
RAG = "SELECT note_id, book_id, score::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY score DESC, note_id) AS rn FROM {} WHERE score > 0 AND book_id IN ({})) WHERE rn <= {}"


def _scored(name: str, table: str, terms: list[str], whole: str) -> str:
    """A common table expression ``name``: the hybrid score of the candidates in ``table``."""
    return f"{name} AS (SELECT *, CASE WHEN contains(x, '{whole}') THEN 12.0 ELSE 0.0 END + {_rule(terms, 'x', ('xt', 5.0), ('xc', 3.0))} AS score FROM {table})"


@query("t_rag_search", ", " + _candidates("cr", "norm", "note_id", ["title", "chapter", "content"], R.match_terms("the er"), 5000) + ", " + _scored("z", "cr", R.search_terms("the er"), "theer") + ", " + RAG.format("z", QUOTA, 3))
def _(s, d):
    return S.rag_search(V.notes(s, d), V.index(s, d, "notes"), "the er", "ask", BOOKS).select("note_id", "book_id", F.col("score").cast("double").alias("score"))


@query("t_rag_branches", ", n AS (SELECT note_id, book_id, 1.0 AS score FROM notes), " + _candidates("cr", "norm", "note_id", ["title", "chapter", "content"], R.match_terms("the er"), 5000) + ", " + _scored("z", "cr", R.search_terms("the er"), "theer")
       + ", q AS (SELECT *, 5.0 AS x5 FROM norm ORDER BY note_id LIMIT 800), " + _scored("y", "q", R.search_terms("zzqx"), "zzqx")
       + f" SELECT 'compare' AS mode, * FROM ({RAG.format('n', QUOTA, 3)}) UNION ALL SELECT 'one', note_id, book_id, score::DOUBLE FROM (SELECT * FROM z WHERE book_id = 'src4' AND score > 0 ORDER BY score DESC, note_id LIMIT 200)"
       + f" UNION ALL SELECT 'few', * FROM ({RAG.format('z', chr(39) + 'src1' + chr(39) + ', ' + chr(39) + 'src2' + chr(39), 5)}) UNION ALL SELECT 'nowhere', * FROM ({RAG.format('y', QUOTA, 3)})")
def _(s, d):
    """Every way a search for an answer can go: nothing asked, one book, a few, words that no note has."""
    n, index = V.notes(s, d), V.index(s, d, "notes")
    cases = [("compare", "", "compare", BOOKS), ("one", "the er", "ask", ["src4"]), ("few", "the er", "ask", ["src1", "src2"]), ("nowhere", "zzqx", "ask", BOOKS)]
    parts = [S.rag_search(n, index, question, mode, books).select(F.lit(case).alias("mode"), "note_id", "book_id", F.col("score").cast("double").alias("score")) for case, question, mode, books in cases]
    return reduce(DataFrame.unionByName, parts)


def _block(terms: list[str], whole: str) -> str:
    return f"CASE WHEN contains(x, '{whole}') THEN 12 + o WHEN o > 0 THEN 4 + o ELSE 0 END"


@query("t_source_evidence", MORE + ", " + _candidates("cs", "srcs", "id", ["title", "heading", "content"], R.match_terms("the er"), 200) + f" SELECT id, title, score FROM (SELECT id, title, CAST({_block(R.search_terms('the er'), 'theer')} AS DOUBLE) AS score FROM (SELECT *, {_rule(R.search_terms('the er'), 'x')} AS o FROM (SELECT *, {_plain('content')} AS x FROM cs))) WHERE score > 0 ORDER BY score DESC, id LIMIT 12")
def _(s, d):
    return S.source_evidence(V.sources(s, d), V.index(s, d, "sources"), "the er", []).select("id", "title", "score")


@query("t_like_fallback", MORE + " SELECT id FROM srcs WHERE contains(lower(content), 'tion') OR contains(lower(heading), 'tion') OR contains(lower(title), 'tion') ORDER BY id LIMIT 5000")
def _(s, d):
    return S.like_any_term(V.sources(s, d), ["tion"], 5000, "id", "content", "heading", "title").select("id")


@query("fn_and_query", "SELECT note_id FROM norm WHERE contains(x, 'the') AND contains(x, 'er')")
def _(s, d):
    return V.notes(s, d).where(R.all_terms(F.col("content"), "the er")).select("note_id")


@query("fn_match_expr", "SELECT note_id FROM (SELECT note_id, regexp_extract_all(strip_accents(lower(concat_ws(' ', title, coalesce(chapter, ''), content))), '[\\p{L}\\p{N}]+') AS w FROM notes) WHERE list_has_any(w, ['the', 'er', 'th', 'he', 'ee'])")
def _(s, d):
    return V.notes(s, d).where(R.has_term(R.match_terms("the er"), "title", "chapter", "content")).select("note_id")


TERM_SQL = """WITH q AS (SELECT item_id, substring(text, 1, 30) AS t FROM benchmark), n AS (SELECT item_id, regexp_replace(lower(t), '[^\\p{L}\\p{N}]', '', 'g') AS whole, list_filter(list_transform(string_split_regex(t, '\\s+'), lambda x: regexp_replace(lower(x), '[^\\p{L}\\p{N}]', '', 'g')), lambda x: x <> '') AS w FROM q),
x AS (SELECT item_id, list_distinct(w || list_transform(range(1, length(whole)), lambda i: substring(whole, i, 2))) AS t FROM n)
SELECT item_id, list_transform(list_sort(list_transform(t, lambda y: {'n': -length(y), 't': y})), lambda z: z.t) AS terms FROM x"""


@query("fn_search_terms", TERM_SQL, base=False, lists=("terms",))
def _(s, d):
    return V.table(s, d, "benchmark").select("item_id", R.terms_of(F.substring("text", 1, 30)).alias("terms"))


@query("t_metadata_context", """WITH m AS (SELECT 'p' || p_partkey AS book_id, CASE WHEN p_partkey % 3 = 0 THEN 'shelf' WHEN p_partkey % 3 = 1 THEN 'review' ELSE 'other' END AS source, p_name AS title, p_brand AS a, p_type AS b, p_name || ' ' || p_type AS description FROM part)
SELECT book_id, source, CASE source WHEN 'shelf' THEN 1 ELSE 2 END AS rank, 'source: ' || source || chr(10) || 'title: ' || title || chr(10) || 'authors: ' || a || chr(10) || 'subjects: ' || b || chr(10) || 'intro: ' || substring(description, 1, 600) AS line FROM m WHERE source <> 'other' AND CAST(substring(book_id, 2) AS BIGINT) BETWEEN 1 AND 20""", base=False)
def _(s, d):
    p, key = V.table(s, d, "part"), F.col("p_partkey")
    m = p.select(F.concat(F.lit("p"), key.cast("string")).alias("book_id"), F.when(key % 3 == 0, "shelf").when(key % 3 == 1, "review").otherwise("other").alias("source"), F.col("p_name").alias("title"), F.array("p_brand").alias("authors"), F.array("p_type").alias("subjects"), F.concat_ws(" ", "p_name", "p_type").alias("description"))
    return S.metadata_context(m, [f"p{i}" for i in range(1, 30)], ["shelf", "review"])


@query("p_prompt_text", "SELECT n, '[' || n || '] ' || title || CASE WHEN chapter <> '' THEN ' / ' || chapter ELSE '' END || chr(10) || substring(trim(content), 1, 700) AS line FROM (SELECT *, CAST(row_number() OVER (ORDER BY created DESC, note_id) AS INTEGER) AS n FROM notes ORDER BY created DESC, note_id LIMIT 40)")
def _(s, d):
    top = V.notes(s, d).orderBy(F.desc("created"), "note_id").limit(40)
    return S.prompt_lines(top, S.note_chars(F.lit("ask"), F.lit(40), F.lit(0)), F.desc("created"), F.asc("note_id"))


@query("t_context_budget", "SELECT user_id, n, m, event_type, CASE event_type WHEN 'click' THEN CASE WHEN n > 100 THEN 220 WHEN n > 30 THEN 700 ELSE 1200 END WHEN 'view' THEN CASE WHEN m > 30 THEN 420 ELSE 700 END ELSE 1200 END AS chars FROM (SELECT user_id, event_type, count(*) * 3 AS n, count(DISTINCT event_id % 50) AS m FROM events GROUP BY 1, 2)", base=False)
def _(s, d):
    g = V.table(s, d, "events").groupBy("user_id", "event_type").agg((F.count(F.lit(1)) * 3).alias("n"), F.count_distinct(F.col("event_id") % 50).alias("m"))
    mode = F.when(F.col("event_type") == "click", "ask").when(F.col("event_type") == "view", "compare").otherwise("outline")
    return g.select("user_id", "n", "m", "event_type", S.note_chars(mode, F.col("n"), F.col("m")).alias("chars"))


@query("p_locator_label", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'p. ' || page_id WHEN page_id % 4 = 1 THEN 'ch. ' || (page_id % 9) WHEN page_id % 4 = 2 THEN 'web page' ELSE coalesce(url, '') END AS label FROM pages", base=False)
def _(s, d):
    k = F.col("page_id")
    return V.table(s, d, "pages").select("page_id", S.locator_label(F.when(k % 4 == 0, k), F.when(k % 4 == 1, k % 9), F.when(k % 4 == 2, "web"), F.col("url")).alias("label"))


ANSWER = "see [1], [3] and [12], but not [W2] or (7)"


@query("t_citations", f"SELECT CAST(n AS INTEGER) AS n, note_id, contains('{ANSWER}', '[W' || n || ']') AS glossary FROM (SELECT note_id, row_number() OVER (ORDER BY created DESC, note_id) AS n FROM notes ORDER BY n LIMIT 20) WHERE contains('{ANSWER}', '[' || n || ']') OR contains('{ANSWER}', '[W' || n || ']')")
def _(s, d):
    top = V.notes(s, d).select("note_id", "created").orderBy(F.desc("created"), "note_id").limit(20)
    numbered = top.select("note_id", F.row_number().over(Window.orderBy(F.desc("created"), "note_id")).alias("n"))
    plain, marked = S.cited(numbered, ANSWER).withColumn("glossary", F.lit(False)), S.cited(numbered, ANSWER, "W").withColumn("glossary", F.lit(True))
    return plain.union(marked).select("n", "note_id", "glossary")


@query("w_citation_number", ", nn AS (SELECT 'note' AS kind, note_id AS id, row_number() OVER (ORDER BY created DESC, note_id) AS n FROM notes ORDER BY n LIMIT 12), ss AS (SELECT 'source' AS kind, 'w' || page_id AS id, row_number() OVER (ORDER BY page_id DESC) AS n FROM pages ORDER BY n LIMIT 6) SELECT kind, id, CAST(n AS INTEGER) AS n FROM nn UNION ALL SELECT kind, id, CAST(n + (SELECT count(*) FROM nn) AS INTEGER) FROM ss")
def _(s, d):
    notes = V.notes(s, d).select(F.lit("note").alias("kind"), F.col("note_id").alias("id"), F.col("created").alias("at")).orderBy(F.desc("at"), "id").limit(12)
    pages = V.table(s, d, "pages").select(F.lit("source").alias("kind"), F.concat(F.lit("w"), F.col("page_id").cast("string")).alias("id"), F.col("page_id").alias("at")).orderBy(F.desc("at")).limit(6)
    n = F.row_number().over(Window.orderBy("kind", F.desc("at"), "id"))  # 18 rows: notes first
    return notes.union(pages).select("kind", "id", n.alias("n"))


# ---- reranking ------------------------------------------------------------

RANKED = "r AS (SELECT doc_id, source AS book_id, text AS content, row_number() OVER (ORDER BY doc_id) - 1 AS index FROM documents ORDER BY doc_id LIMIT 300)"


def _ranked(s, d):
    top = V.table(s, d, "documents").select("doc_id", F.col("source").alias("book_id"), F.col("text").alias("content")).orderBy("doc_id").limit(300)
    return top.withColumn("index", (F.row_number().over(Window.orderBy("doc_id")) - 1).cast("bigint"))  # what a search returned


@query("t_rerank_prepare", f"WITH {RANKED} SELECT CAST(min(index) AS BIGINT) AS index, document FROM (SELECT index, trim(substring(content, 1, 600)) AS document FROM r WHERE index < 100) WHERE document <> '' GROUP BY document", base=False)
def _(s, d):
    return K.prepare(_ranked(s, d))


@query("u_dedup_docs", f"WITH {RANKED} SELECT CAST(min(index) AS BIGINT) AS index FROM (SELECT index, trim(substring(content, 1, 600)) AS document FROM r WHERE index < 100) WHERE document <> '' GROUP BY document", base=False)
def _(s, d):
    return K.prepare(_ranked(s, d)).select("index")


@query("t_rerank_validate", "SELECT case_id, problem FROM (VALUES ('outside', 'outside'), ('repeated', 'repeated'), ('not finite', 'not finite'), ('empty', 'empty')) t(case_id, problem)", base=False)
def _(s, d):
    cases = {"sound": [(0, 0.5), (2, None)], "outside": [(0, 0.5), (3, 0.1)], "repeated": [(1, 0.5), (1, 0.2)], "not finite": [(0, float("nan"))], "empty": []}
    each = [K.problems(s.createDataFrame(x, "index int, score double"), 3).select(F.lit(name).alias("case_id"), "problem") for name, x in cases.items()]
    out = each[0]
    for x in each[1:]:
        out = out.union(x)
    return out


@query("t_rerank_map", f"WITH {RANKED}, p AS (SELECT min(index) AS index FROM (SELECT index, trim(substring(content, 1, 600)) AS document FROM r WHERE index < 100) WHERE document <> '' GROUP BY document), k AS (SELECT index, row_number() OVER (ORDER BY index) - 1 AS i, count(*) OVER () AS n FROM p) SELECT index, CAST(rank AS INTEGER) AS rank FROM (SELECT index, n - i AS rank FROM k UNION ALL SELECT index, (SELECT count(*) FROM k) + row_number() OVER (ORDER BY index) FROM r WHERE index NOT IN (SELECT index FROM k))", base=False)
def _(s, d):
    settings = K.Settings(True, "p", "https://example.org", "m", 20)
    ordered, warning = K.rerank(_ranked(s, d), "what", "ask", settings, lambda q, docs: [(i, float(i)) for i in reversed(range(len(docs)))])
    assert not warning
    return ordered.select("index", F.row_number().over(Window.orderBy(F.desc_nulls_last("rerank"), "index")).alias("rank"))


@query("t_rerank_gate", f"WITH {RANKED} SELECT index, CAST(index + 1 AS INTEGER) AS rank FROM r", base=False)
def _(s, d):
    settings = K.Settings(True, "p", "https://example.org", "m", 51)  # too large a top_n: the order stays
    ordered, _ = K.rerank(_ranked(s, d), "what", "ask", settings, lambda q, docs: [(0, 1.0)])
    return ordered.select("index", F.row_number().over(Window.orderBy("index")).alias("rank"))


@query("w_book_coverage", f"WITH {RANKED}, c AS (SELECT index, book_id, row_number() OVER (PARTITION BY book_id ORDER BY index) > 2 AS o FROM r) SELECT index, book_id FROM c ORDER BY o, index LIMIT 50", base=False)
def _(s, d):
    return K.coverage(_ranked(s, d).select(F.col("index").alias("rank"), "book_id"), 50).select(F.col("rank").alias("index"), "book_id")


@query("t_combine_scores", "SELECT doc_id, round(0.70 * n_chars / max(n_chars) OVER () + 0.30 * coalesce(quality / nullif(max(quality) OVER (), 0), 0), 9) AS two, round(0.85 * (doc_id % 10) / max(doc_id % 10) OVER () + 0.10 * n_chars / max(n_chars) OVER () + 0.05 * coalesce(quality / nullif(max(quality) OVER (), 0), 0), 9) AS three FROM documents JOIN labels USING (doc_id)", base=False)
def _(s, d):
    x = V.table(s, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("lexical"), (F.col("doc_id") % 10).cast("double").alias("rerank"))
    x = x.join(V.table(s, d, "labels").select("doc_id", F.col("quality").cast("double").alias("semantic")), "doc_id")
    for c in ("lexical", "semantic", "rerank"):
        x = R.peak_normalize(x, c)
    return x.select("doc_id", F.round(R.combined(F.col("lexical"), F.col("semantic")), 9).alias("two"), F.round(R.combined(F.col("lexical"), F.col("semantic"), F.col("rerank")), 9).alias("three"))


# ---- glossary -------------------------------------------------------------


def _tiers(q: str) -> str:
    return f"CASE WHEN lower(canonical_name) = '{q}' THEN 0 WHEN lower(term) = '{q}' THEN 1 WHEN len(list_filter(aliases, lambda a: lower(a) = '{q}')) > 0 THEN 2 WHEN starts_with(lower(term), '{q}') THEN 3 ELSE 4 END"


def _matches(q: str) -> str:
    return f"(lower(term) LIKE '%{q}%' OR lower(canonical_name) LIKE '%{q}%' OR lower(definition) LIKE '%{q}%' OR len(list_filter(aliases, lambda a: lower(a) LIKE '%{q}%')) > 0)"


@query("t_glossary_search", MORE + f" SELECT id, {_tiers('alias7')} AS tier FROM terms WHERE {_matches('a')} AND {_matches('alias7')}")
def _(s, d):
    return Y.search(Y.search(V.terms(s, d), "a").drop("tier"), "alias7").select("id", "tier")


@query("s_rank_case", MORE + f" SELECT id, {_tiers('al')} AS tier FROM terms WHERE {_matches('al')} ORDER BY tier, updated_at DESC, id LIMIT 100")
def _(s, d):
    return Y.search(V.terms(s, d), "al", most=100).select("id", "tier")


@query("m_review_queue", MORE + f" SELECT id, status FROM terms WHERE {_matches('')} AND source = 'manual' AND status = 'pending' ORDER BY {_tiers('')}, updated_at DESC, id LIMIT 200")
def _(s, d):
    return Y.review_queue(V.terms(s, d), "", "manual", "pending").select("id", "status")


@query("m_glossary_status", MORE + " SELECT id, CASE WHEN id % 6 = 0 THEN 'conflict' ELSE status END AS status, CASE WHEN id % 6 = 0 THEN 1800000000 ELSE updated_at END AS updated_at FROM terms")
def _(s, d):
    t = V.terms(s, d)
    return Y.set_status(t, t.where("id % 6 = 0").select("id"), "conflict", F.lit(1800000000).cast("bigint")).select("id", "status", "updated_at")


@query("m_glossary_save", MORE + """, e AS (SELECT CASE WHEN id % 3 = 0 THEN id + 100000 WHEN id % 3 = 1 THEN id ELSE 0 END AS id, id AS old, CASE WHEN id % 3 = 0 THEN 'new' || id WHEN id % 3 = 1 THEN 'renamed' || id ELSE 'fresh' || id END AS term, canonical_name, definition || CASE WHEN id % 2 = 0 THEN ' more' ELSE '' END AS definition, '' AS source, CASE WHEN id % 2 = 0 THEN 'confirmed' ELSE '' END AS status, ['mine'] AS aliases FROM terms WHERE id % 4 <> 3)
SELECT t.id, coalesce(e.term, t.term) AS term, trim(coalesce(e.definition, t.definition)) AS definition, CASE WHEN e.id IS NULL OR t.source = 'encyclopedia' THEN t.source ELSE 'manual' END AS source, CASE WHEN e.id IS NULL THEN t.status ELSE coalesce(nullif(e.status, ''), t.status) END AS status,
 CASE WHEN e.id IS NULL THEN t.aliases WHEN t.source = 'encyclopedia' THEN list_sort(list_distinct(list_concat(t.aliases, e.aliases))) ELSE e.aliases END AS aliases,
 CASE WHEN e.id IS NULL THEN t.manually_edited WHEN t.source = 'encyclopedia' THEN t.manually_edited OR e.definition <> t.definition ELSE TRUE END AS manually_edited FROM terms t LEFT JOIN (SELECT * FROM e WHERE id BETWEEN 1 AND 99999) e ON e.id = t.id
UNION ALL SELECT (SELECT max(id) FROM terms) + row_number() OVER (ORDER BY term), term, trim(definition), 'manual', coalesce(nullif(status, ''), 'confirmed'), aliases, TRUE FROM e WHERE id > 99999 OR id = 0""", lists=("aliases",))
def _(s, d):
    t = V.terms(s, d)
    k = F.col("id")
    edits = t.where("id % 4 <> 3").select(
        F.when(k % 3 == 0, k + 100000).when(k % 3 == 1, k).otherwise(0).alias("id"), F.concat(F.when(k % 3 == 0, "new").when(k % 3 == 1, "renamed").otherwise("fresh"), k.cast("string")).alias("term"), "canonical_name",
        F.concat("definition", F.when(k % 2 == 0, " more").otherwise("")).alias("definition"), F.lit("").alias("source"), F.when(k % 2 == 0, "confirmed").otherwise("").alias("status"), F.array(F.lit("mine")).alias("aliases"),
    )
    return Y.save(t, edits, F.lit(1800000000).cast("bigint")).select("id", "term", F.trim("definition").alias("definition"), "source", "status", "aliases", "manually_edited")


@query("m_alias_sync", MORE + ", a AS (SELECT id, trim(unnest(aliases)) AS alias FROM terms UNION ALL SELECT id, 'Alias' || id FROM terms WHERE id % 2 = 0), o AS (SELECT id, lower(alias) AS k, min(alias) AS alias FROM a WHERE alias <> '' GROUP BY 1, 2) SELECT id AS term_id, list(alias ORDER BY alias) AS aliases FROM o GROUP BY 1", lists=("aliases",))
def _(s, d):
    t = V.terms(s, d)
    manual = t.where("id % 2 = 0").select(F.col("id").alias("term_id"), F.concat(F.lit("Alias"), F.col("id").cast("string")).alias("alias"))
    return Y.sync_aliases(t.select(F.col("id").alias("term_id"), F.explode("aliases").alias("alias")), manual)


TEXT = "the history of alias12, alias13 and alias14; also alias17 or ALIAS18 with alias21 alias22 alias23 alias24 alias27"


@query("t_glossary_context", MORE + f" SELECT CAST(row_number() OVER (ORDER BY updated_at DESC, id) AS INTEGER) AS n, coalesce(nullif(canonical_name, ''), term) AS term, substring(definition, 1, 8000) AS definition FROM (SELECT * FROM terms WHERE status = 'confirmed' AND len(list_filter(list_concat([term, canonical_name], aliases), lambda a: trim(a) <> '' AND contains('{TEXT.lower()}', lower(a)))) > 0 ORDER BY updated_at DESC, id LIMIT 8)")
def _(s, d):
    return Y.named_in(V.terms(s, d), TEXT)


@query("j_contains", "SELECT note_id, item_id FROM notes JOIN (SELECT item_id, split_part(text, ' ', 1) AS term FROM benchmark) ON length(term) >= 4 AND contains(lower(content), lower(term))")
def _(s, d):
    t = V.table(s, d, "benchmark").select(F.col("item_id").alias("term_id"), F.lower(F.split_part("text", F.lit(" "), F.lit(1))).alias("term")).where("char_length(term) >= 4")
    return Y.named_pairs(V.notes(s, d), t, "note_id", "content").select(F.col("id").alias("note_id"), F.col("term_id").alias("item_id"))


FUZZY = """WITH c AS (SELECT p_partkey AS id, p_partkey * 5 + i AS key, CASE i WHEN 0 THEN p_name || '：a subtitle' WHEN 1 THEN p_name || ' extra' WHEN 2 THEN 'none of these' WHEN 3 THEN '(' || p_name || ')' ELSE NULL END AS title,
  CASE WHEN p_partkey % 2 = i % 2 THEN 'By ' || p_brand WHEN p_partkey % 7 = 0 THEN '' ELSE 'zz' END AS author FROM part, range(0, 5) r(i) WHERE NOT (i < 2 AND p_partkey % 5 < 2) AND NOT (i = 4 AND p_partkey % 3 > 0)),
n AS (SELECT c.id, key, T2 AS t2, A2 AS a2, T1 AS t1, A1 AS a1 FROM c JOIN part p ON p.p_partkey = c.id),
s AS (SELECT id, key, contains(t1, t2) OR contains(t2, t1) AS near, CASE WHEN t1 = t2 THEN 100 WHEN t1 <> '' AND (contains(t1, t2) OR contains(t2, t1)) THEN 60 ELSE 0 END + CASE WHEN a1 <> '' AND (contains(a1, a2) OR contains(a2, a1)) THEN 20 ELSE 0 END AS x, CASE WHEN t1 = t2 THEN 100 WHEN contains(t1, t2) OR contains(t2, t1) THEN 60 ELSE 0 END + CASE WHEN a1 <> '' AND contains(a2, a1) THEN 30 ELSE 0 END AS y FROM n)
SELECT 'authors' AS by, id, arg_max(key, (x, key)) AS key, max(x) AS score FROM s GROUP BY id HAVING max(x) > 0
UNION ALL SELECT 'abstract', id, key, y FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY y DESC, key DESC) AS rn FROM s) WHERE rn = 1 AND near""".replace("T2", _plain("trim(regexp_extract(c.title, '^[^：:（(【\\[]*'))")).replace("A2", _plain("c.author")).replace("T1", _plain("p.p_name")).replace("A1", _plain("p.p_brand"))


@query("j_fuzzy_best", FUZZY, base=False)
def _(s, d):
    p = V.table(s, d, "part").select("p_partkey", "p_name", "p_brand")
    wanted = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"))
    i, k = F.col("i"), F.col("p_partkey")
    c = p.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(4)))).where(~((i < 2) & (k % 5 < 2)) & ~((i == 4) & (k % 3 > 0)))
    title = F.when(i == 0, F.concat("p_name", F.lit("：a subtitle"))).when(i == 1, F.concat("p_name", F.lit(" extra"))).when(i == 2, "none of these").when(i == 3, F.concat(F.lit("("), "p_name", F.lit(")")))
    author = F.when(k % 2 == i % 2, F.concat(F.lit("By "), "p_brand")).when(k % 7 == 0, "").otherwise("zz")
    found = c.select(k.alias("id"), (k * 5 + i).alias("key"), title.alias("title"), author.alias("author"))
    return reduce(DataFrame.unionByName, [S.fuzzy_best(wanted, found, by).select(F.lit(by).alias("by"), "*") for by in ("authors", "abstract")])
