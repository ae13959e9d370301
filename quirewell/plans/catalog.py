"""Queries over the driver's tables, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import ingest as I
from ..operators import jobs as J
from ..operators import library as L
from ..operators import retrieval as R
from ..sources import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

BASE = """
WITH books AS (
  SELECT source AS book_id, 'Book ' || source AS title, 'author' || (n % 7) AS author,
         CASE WHEN n % 6 = 0 THEN '' ELSE 'cat' || (n % 4) END AS category, n % 3 = 0 AS finish_reading,
         CASE WHEN n % 5 <> 0 THEN 1700000000 + n * 86400 END AS read_update_time, n = 10 AS is_deleted
  FROM (SELECT DISTINCT source, CAST(substring(source, 4) AS BIGINT) AS n FROM documents)),
all_notes AS (
  SELECT CASE WHEN doc_id % 3 <> 0 THEN 'h' ELSE 't' END || doc_id AS note_id,
         CASE WHEN doc_id % 3 <> 0 THEN 'highlight' ELSE 'thought' END AS note_type, source AS book_id, lang AS chapter,
         text AS content, 1700000000 + doc_id * 60 AS created,
         CASE WHEN doc_id % 3 <> 0 THEN doc_id % 17 = 0 ELSE doc_id % 19 = 0 END AS is_deleted
  FROM documents),
highlights AS (SELECT * FROM all_notes WHERE note_type = 'highlight'),
thoughts AS (SELECT * FROM all_notes WHERE note_type = 'thought'),
notes AS (SELECT n.* EXCLUDE (is_deleted), b.title FROM all_notes n JOIN books b USING (book_id) WHERE NOT n.is_deleted AND NOT b.is_deleted),
listed AS (
  SELECT b.book_id, b.title, b.author, b.category, coalesce(h.n, 0) AS highlight_count, coalesce(t.n, 0) AS thought_count,
         CASE WHEN finish_reading THEN 100 ELSE 0 END AS progress,
         coalesce(strftime(make_timestamp(read_update_time * 1000000), '%Y-%m-%d %H:%M:%S'), '') AS updated_at,
         CASE WHEN finish_reading THEN 'finished' WHEN coalesce(read_update_time, 0) > 0 OR coalesce(h.n, 0) > 0 OR coalesce(t.n, 0) > 0 THEN 'reading' ELSE 'unread' END AS reading_status,
         b.read_update_time
  FROM books b LEFT JOIN (SELECT book_id, count(*) AS n FROM highlights WHERE NOT is_deleted GROUP BY 1) h USING (book_id)
  LEFT JOIN (SELECT book_id, count(*) AS n FROM thoughts WHERE NOT is_deleted GROUP BY 1) t USING (book_id)
  WHERE NOT b.is_deleted),
norm AS (SELECT *, regexp_replace(lower(content), '[^\\p{L}\\p{N}]', '', 'g') AS x, regexp_replace(lower(title), '[^\\p{L}\\p{N}]', '', 'g') AS xt, lower(chapter) AS xc FROM notes)
"""


def query(name: str, sql: str | None = None, base: bool = True, lists: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query and its SQL; both give the columns in ``lists`` with | between their elements, as single values can be compared anywhere."""

    def put(f: Query) -> Query:
        joined = lambda s, d: f(s, d).withColumns({c: F.array_join(F.col(c).cast("array<string>"), "|") for c in lists})
        QUERIES[name] = joined if lists else f
        if sql:
            whole = (BASE if base else "") + sql
            each = ", ".join(f"array_to_string(CAST({c} AS VARCHAR[]), '|') AS {c}" for c in lists)
            SQL[name] = f"SELECT * REPLACE ({each}) FROM ({whole})" if lists else whole
        return f

    return put


def _listed(s: SparkSession, d: str) -> DataFrame:
    return L.book_list(V.books(s, d), V.highlights(s, d), V.thoughts(s, d))


# ---- library --------------------------------------------------------------


@query("a_dashboard", "SELECT (SELECT count(*) FROM books WHERE NOT is_deleted) AS books, (SELECT count(*) FROM highlights WHERE NOT is_deleted) AS highlights, (SELECT count(*) FROM thoughts WHERE NOT is_deleted) AS thoughts")
def _(s, d):
    return L.note_counts(V.books(s, d), V.highlights(s, d), V.thoughts(s, d))


@query("a_overview", "SELECT CASE WHEN trim(coalesce(category, '')) = '' THEN 'Uncategorised' ELSE category END AS label, count(*) AS count FROM books WHERE NOT is_deleted GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def _(s, d):
    return L.category_histogram(V.books(s, d))


@query("a_count_by", "SELECT note_type, is_deleted, count(*) AS n FROM all_notes GROUP BY 1, 2")
def _(s, d):
    return V.all_notes(s, d).groupBy("note_type", "is_deleted").agg(F.count(F.lit(1)).alias("n"))


@query("a_book_counts", "SELECT book_id, count(*) AS n FROM highlights WHERE NOT is_deleted GROUP BY 1")
def _(s, d):
    return V.highlights(s, d).where(~F.col("is_deleted")).groupBy("book_id").agg(F.count(F.lit(1)).alias("n"))


@query("a_sync_counts", "SELECT count(*) FILTER (NOT is_deleted) AS live, count(*) FILTER (is_deleted) AS deleted FROM all_notes")
def _(s, d):
    return V.all_notes(s, d).agg(F.count_if(~F.col("is_deleted")).alias("live"), F.count_if(F.col("is_deleted")).alias("deleted"))


@query("a_distinct_categories", "SELECT DISTINCT trim(category) AS category FROM books WHERE NOT is_deleted AND trim(coalesce(category, '')) <> ''")
def _(s, d):
    return V.books(s, d).where("NOT is_deleted AND trim(coalesce(category, '')) <> ''").select(F.trim("category").alias("category")).distinct()


@query("j_left_counts", "SELECT * EXCLUDE (read_update_time) FROM listed")
def _(s, d):
    return _listed(s, d).drop("read_update_time")


@query("l_total_page", "SELECT book_id, highlight_count, reading_status FROM listed WHERE author LIKE '%author1%' OR title LIKE '%1%' ORDER BY highlight_count DESC, book_id LIMIT 5 OFFSET 2")
def _(s, d):
    listed = _listed(s, d).where(L.like_any("1", "title") | L.like_any("author1", "author"))
    return L.book_page(listed, sort_by="highlights", limit=5, offset=2).select("book_id", "highlight_count", "reading_status")


@query("l_page_facets", """, f AS (SELECT * FROM listed WHERE (lower(title) LIKE '%1%' OR lower(author) LIKE '%1%') AND (highlight_count > 0))
SELECT 'page' AS part, book_id AS value, 1::BIGINT AS n, CAST(row_number() OVER (ORDER BY highlight_count DESC, book_id) AS INTEGER) AS place FROM (SELECT * FROM f ORDER BY highlight_count DESC, book_id LIMIT 4 OFFSET 1)
UNION ALL SELECT 'total', '', count(*), 0 FROM f UNION ALL SELECT 'category', category, count(*), 0 FROM f GROUP BY category UNION ALL SELECT 'reading_status', reading_status, count(*), 0 FROM f GROUP BY reading_status""")
def _(s, d):
    return L.page_with_facets(_listed(s, d), query="1", with_highlights=True, sort_by="highlights", limit=4, offset=1)


@query("f_optional", "SELECT book_id, title, updated_at FROM listed WHERE reading_status = 'reading' AND thought_count > 0 ORDER BY lower(title), book_id LIMIT 500")
def _(s, d):
    return L.book_page(_listed(s, d), status="reading", with_thoughts=True, sort_by="title", limit=500).select("book_id", "title", "updated_at")


@query("p_reading_status", "SELECT book_id, reading_status, progress FROM listed")
def _(s, d):
    return _listed(s, d).select("book_id", "reading_status", "progress")


@query("scan_table", "SELECT n.note_id AS id, content AS primary, coalesce(title, '') AS secondary, coalesce(chapter, '') AS detail, strftime(make_timestamp(created * 1000000), '%Y-%m-%d %H:%M:%S') AS created_at FROM all_notes n LEFT JOIN books USING (book_id) WHERE NOT n.is_deleted AND (lower(content) LIKE '%th%' OR lower(chapter) LIKE '%th%' OR lower(coalesce(title, '')) LIKE '%th%') ORDER BY created DESC, id LIMIT 50 OFFSET 10".replace("primary", '"primary"'))
def _(s, d):
    return L.browse(V.all_notes(s, d), V.books(s, d), "th", 50, 10)


WHEN_AT = "coalesce(strftime(make_timestamp({} * 1000000), '%Y-%m-%d %H:%M:%S'), '')"
BROWSE = f""", g AS (SELECT item_id AS id, split_part(text, ' ', 1) AS term, split_part(text, ' ', 2) AS name, text AS definition, 1700000000 + item_id AS at FROM benchmark),
se AS (SELECT event_id AS id, event_type AS status, 'src' || (user_id % 3) AS source, 1700000000 + event_id AS at, event_id % 5 AS b, event_id % 7 AS h, event_id % 11 AS t FROM events),
me AS (SELECT 'src' || (p_partkey % 25) AS book_id, p_brand AS source, p_name AS title, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE '' END AS publisher, p_brand AS authors, 1700000000 + p_partkey AS at FROM part),
r AS (SELECT 'books' AS tab, book_id AS id, title AS "primary", coalesce(author, '') AS secondary, coalesce(category, '') AS detail, read_update_time AS at FROM books WHERE NOT is_deleted AND (lower(title) LIKE '%1%' OR lower(author) LIKE '%1%' OR lower(book_id) LIKE '%1%')
UNION ALL SELECT note_type || 's', note_id, content, coalesce(title, ''), coalesce(chapter, ''), created FROM all_notes n LEFT JOIN books USING (book_id) WHERE NOT n.is_deleted AND (lower(content) LIKE '%1%' OR lower(chapter) LIKE '%1%' OR lower(coalesce(title, '')) LIKE '%1%')
UNION ALL SELECT 'sessions', id::VARCHAR, status, source, 'books ' || b || ' · highlights ' || h || ' · thoughts ' || t, at FROM se WHERE lower(source) LIKE '%1%' OR lower(status) LIKE '%1%'
UNION ALL SELECT 'metadata', book_id, coalesce(b.title, me.title, book_id), source, coalesce(nullif(publisher, ''), authors, ''), at FROM me LEFT JOIN books b USING (book_id) WHERE lower(coalesce(b.title, '')) LIKE '%1%' OR lower(source) LIKE '%1%' OR lower(publisher) LIKE '%1%' OR lower(authors) LIKE '%1%' OR book_id LIKE '%1%'
UNION ALL SELECT 'terms', id::VARCHAR, term, name, substring(definition, 1, 200), at FROM g WHERE lower(term) LIKE '%1%' OR lower(name) LIKE '%1%' OR lower(definition) LIKE '%1%'),
n AS (SELECT *, row_number() OVER (PARTITION BY tab ORDER BY at DESC NULLS LAST, id) AS rn, count(*) OVER (PARTITION BY tab) AS total FROM r)
SELECT tab, id, "primary", secondary, detail, {WHEN_AT.format('at')} AS created_at, total FROM n WHERE rn BETWEEN 4 AND 23""".replace(" at FROM", ' "at" FROM').replace(" AS at", ' AS "at"').replace("ORDER BY at", 'ORDER BY "at"').replace("(at *", '("at" *')


@query("scan_tables", BROWSE)
def _(s, d):
    b, lit = V.books(s, d), F.lit
    e, k = V.table(s, d, "events"), F.col("event_id")
    sessions = e.select(k.cast("string").alias("id"), F.col("event_type").alias("status"), F.concat(lit("src"), (F.col("user_id") % 3).cast("string")).alias("source"), lit(None).cast("string").alias("error"), (k % 5).alias("books"), (k % 7).alias("highlights"), (k % 11).alias("thoughts"), (k + V.BASE_TIME).alias("started_at"))
    p, q = V.table(s, d, "part"), F.col("p_partkey")
    meta = p.select(F.concat(lit("src"), (q % 25).cast("string")).alias("book_id"), F.col("p_brand").alias("source"), F.col("p_name").alias("title"), F.when(q % 2 == 0, F.col("p_type")).otherwise("").alias("publisher"), F.col("p_brand").alias("authors"), (q + V.BASE_TIME).alias("fetched_at"))
    m, i = V.table(s, d, "benchmark"), F.col("item_id")
    terms = m.select(i.alias("id"), F.split_part("text", lit(" "), lit(1)).alias("term"), F.split_part("text", lit(" "), lit(2)).alias("canonical_name"), F.col("text").alias("definition"), (i + V.BASE_TIME).alias("updated_at"))
    tables = {"books": b, "highlights": V.highlights(s, d), "thoughts": V.thoughts(s, d), "sessions": sessions, "metadata": meta, "terms": terms}
    return reduce(DataFrame.unionByName, [L.browse_table(name, rows, b, "1", 20, 3).select(lit(name).alias("tab"), "*") for name, rows in tables.items()])


@query("u_notes_union", "SELECT note_id, note_type, book_id, chapter, created FROM notes")
def _(s, d):
    return V.notes(s, d).select("note_id", "note_type", "book_id", "chapter", "created")


@query("m_book_notes", "SELECT note_id, note_type, content FROM notes WHERE book_id = 'src3' ORDER BY created DESC, note_id")
def _(s, d):
    return V.notes(s, d).where("book_id = 'src3'").orderBy(F.desc("created"), "note_id").select("note_id", "note_type", "content")


@query("s_recent", "SELECT note_id, created FROM notes ORDER BY created DESC, note_id LIMIT 30")
def _(s, d):
    return V.notes(s, d).orderBy(F.desc("created"), "note_id").select("note_id", "created").limit(30)


@query("l_keyset", "SELECT doc_id, lang FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 50", base=False)
def _(s, d):
    return V.table(s, d, "documents").where("doc_id > 100").orderBy("doc_id").select("doc_id", "lang").limit(50)


@query("j_anti_not_exists", "SELECT book_id FROM books b WHERE NOT is_deleted AND NOT EXISTS (SELECT 1 FROM thoughts t WHERE t.book_id = b.book_id AND NOT t.is_deleted AND t.chapter = 'es')")
def _(s, d):
    t = V.thoughts(s, d).where("NOT is_deleted AND chapter_name = 'es'").select("book_id")
    return V.books(s, d).where("NOT is_deleted").join(t, "book_id", "left_anti").select("book_id")


@query("j_semi_exists", "SELECT book_id FROM books b WHERE EXISTS (SELECT 1 FROM highlights h WHERE h.book_id = b.book_id AND h.chapter = 'fr')")
def _(s, d):
    return V.books(s, d).join(V.highlights(s, d).where("chapter_title = 'fr'"), "book_id", "left_semi").select("book_id")


@query("a_chapter_group", "SELECT book_id, coalesce(nullif(trim(chapter), ''), 'other') AS chapter, count(*) AS n, min(created) AS first FROM notes GROUP BY 1, 2")
def _(s, d):
    c = F.coalesce(F.nullif(F.trim("chapter"), F.lit("")), F.lit("other"))
    return V.notes(s, d).groupBy("book_id", c.alias("chapter")).agg(F.count(F.lit(1)).alias("n"), F.min("created").alias("first"))


@query("a_group_concat_max", "SELECT book_id, string_agg(DISTINCT chapter, ',' ORDER BY chapter) AS sources, max(created) AS latest FROM notes GROUP BY 1")
def _(s, d):
    return V.notes(s, d).groupBy("book_id").agg(F.concat_ws(",", F.array_sort(F.collect_set("chapter"))).alias("sources"), F.max("created").alias("latest"))


@query("w_topn_per_group", "SELECT book_id, note_id, rank FROM (SELECT book_id, note_id, CAST(row_number() OVER (PARTITION BY book_id ORDER BY created DESC, note_id) AS INTEGER) AS rank FROM notes) WHERE rank <= 250")
def _(s, d):
    return L.top_per_group(V.notes(s, d).select("book_id", "note_id", "created"), "book_id", 250, F.desc("created"), F.asc("note_id")).select("book_id", "note_id", "rank")


@query("w_history_tail", "SELECT conv_id, turn, role, substring(text, 1, 1200) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 8", base=False)
def _(s, d):
    return R.history_tail(V.table(s, d, "conversations"))


@query("p_snippet", "SELECT note_id, CASE WHEN length(trim(content)) > 160 THEN substring(trim(content), 1, 160) || '…' ELSE trim(content) END AS snippet FROM notes")
def _(s, d):
    return V.notes(s, d).select("note_id", T.snippet(F.col("content")).alias("snippet"))


@query("p_subtitle", "SELECT book_id, concat_ws(' · ', nullif(trim(author), ''), nullif(trim(category), '')) AS subtitle FROM books")
def _(s, d):
    part = lambda c: F.nullif(F.trim(c), F.lit(""))
    return V.books(s, d).select("book_id", F.concat_ws(" · ", part("author"), part("category")).alias("subtitle"))


@query("snk_upsert", "SELECT coalesce(n.book_id, b.book_id) AS book_id, coalesce(n.title, b.title) AS title, coalesce(n.category, b.category) AS category FROM books b FULL JOIN (SELECT 'src' || (p_partkey % 40) AS book_id, min(p_name) AS title, CAST(NULL AS VARCHAR) AS category FROM part GROUP BY 1) n ON n.book_id = b.book_id")
def _(s, d):
    new = V.table(s, d, "part").groupBy(F.concat(F.lit("src"), (F.col("p_partkey") % 40).cast("string")).alias("book_id")).agg(F.min("p_name").alias("title")).withColumn("category", F.lit(None).cast("string"))
    return L.merge_upsert(V.books(s, d).select("book_id", "title", "category"), new, ["book_id"])


@query("st_mark_sweep", "SELECT note_id, is_deleted OR (doc % 2 = 1 AND book_id <> 'src5') AS is_deleted FROM (SELECT *, CAST(substring(note_id, 2) AS BIGINT) AS doc FROM all_notes)")
def _(s, d):
    n = V.all_notes(s, d).select("note_id", "book_id", "is_deleted")
    seen = n.where("cast(substring(note_id, 2) as bigint) % 2 = 0").select("note_id")
    exempt = V.books(s, d).where("book_id = 'src5'").select("book_id")
    return L.mark_sweep(n, seen, "note_id", exempt).select("note_id", "is_deleted")


@query("snk_raw_landing", "SELECT user_id, event_type, event_id, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1", base=False)
def _(s, d):
    return L.latest(V.table(s, d, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id", "props")


@query("snk_prune", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderdate < DATE '1998-01-01' - INTERVAL 30 DAY)", base=False)
def _(s, d):
    o = V.table(s, d, "orders")
    day = lambda c: F.unix_timestamp(c.cast("timestamp"))
    jobs = o.select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("parsing").alias("status"), day(F.col("o_orderdate")).alias("finished_at"))
    staged = V.table(s, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), "l_linenumber", "l_partkey")
    return J.prune(jobs, staged, day(F.lit("1998-01-01")), 30).withColumnRenamed("job_id", "l_orderkey")


# ---- functions ------------------------------------------------------------


@query("fn_normalize_search", "SELECT note_id, x AS normalized FROM norm")
def _(s, d):
    return V.notes(s, d).select("note_id", T.normalize_search(F.col("content")).alias("normalized"))


@query("fn_bigrams", "SELECT note_id, CAST(list_unique(list_transform(range(1, length(x)), lambda i: substring(x, i, 2))) AS BIGINT) AS n FROM norm")
def _(s, d):
    return V.notes(s, d).select("note_id", F.size(T.bigrams(T.normalize_search(F.col("content")))).cast("bigint").alias("n"))


@query("fn_occurrences_cap4", "SELECT note_id, CAST(least(4, (length(x) - length(replace(x, 'er', ''))) // 2) AS BIGINT) AS n FROM norm")
def _(s, d):
    return V.notes(s, d).select("note_id", T.occurrences(T.normalize_search(F.col("content")), "er").alias("n"))


@query("fn_wiki_title", "SELECT p_partkey, upper(substring(t, 1, 1)) || substring(t, 2) AS title FROM (SELECT p_partkey, nfc_normalize(trim(regexp_replace(replace(CASE WHEN p_partkey % 2 = 0 THEN 'e' || chr(769) || '_' ELSE '  ' END || p_name || '__' || p_partkey || 'u' || chr(776), '_', ' '), '\\s+', ' ', 'g'))) AS t FROM part)", base=False)
def _(s, d):
    k = F.col("page_id")
    title = F.concat(F.when(k % 2 == 0, "e\u0301_").otherwise("  "), F.regexp_replace("raw_title", "_[0-9]+$", ""), F.lit("__"), k.cast("string"), F.lit("u\u0308"))
    return V.wiki_pages(s, d).select(k.alias("p_partkey"), T.wiki_title(title).alias("title"))


@query("fn_page_url", "SELECT p_partkey, 'https://example.org/wiki/' || url_encode(replace(p_name, ' ', '_')) AS url FROM part", base=False)
def _(s, d):
    return V.table(s, d, "part").select("p_partkey", T.page_url(F.col("p_name"), "https://example.org/wiki/").alias("url"))


@query("e_dedup_hash", "SELECT doc_id, h, count(*) OVER (PARTITION BY h) AS n, min(doc_id) OVER (PARTITION BY h) AS first FROM (SELECT doc_id, md5('web|' || lower(trim(source)) || '|' || text) AS h FROM documents)", base=False)
def _(s, d):
    h = V.table(s, d, "documents").select("doc_id", I.content_hash(F.lit("web"), F.col("source"), F.col("text")).alias("h"))
    g = h.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    return h.join(g, "h").select("doc_id", "h", "n", "first")


# ---- retrieval ------------------------------------------------------------


def _hybrid_sql(query_text: str, terms: list[str], words: list[str], limit: int) -> str:
    whole = "".join(query_text.split())
    tf = ", ".join(f"len(list_filter(w, lambda t: t = '{x}')) AS tf{i}" for i, x in enumerate(words))
    some = " OR ".join(f"tf{i} > 0" for i in range(len(words)))
    stat = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(words)))
    bm = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in range(len(words)))
    score = f"CASE WHEN contains(x, '{whole}') THEN 12.0 ELSE 0.0 END" + "".join(f" + CASE WHEN contains(xt, '{t}') THEN 5.0 ELSE 0.0 END + CASE WHEN contains(xc, '{t}') THEN 3.0 ELSE 0.0 END + least(4, (length(x) - length(replace(x, '{t}', ''))) // {len(t)})" for t in terms)
    return f""",
w AS (SELECT *, regexp_extract_all(strip_accents(lower(concat_ws(' ', title, coalesce(chapter, ''), coalesce(content, '')))), '[\\p{{L}}\\p{{N}}]+') AS w FROM norm),
f AS (SELECT *, len(w) AS len, {tf} FROM w),
st AS (SELECT count(*) AS n, avg(len) AS mean, {stat} FROM f),
c AS (SELECT f.*, {bm} AS bm FROM f, st WHERE {some} ORDER BY bm DESC, note_id LIMIT 5000),
sc AS (SELECT note_id, note_type, book_id, title, chapter, CAST({score} AS DOUBLE) AS score FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY score DESC, note_id) AS rn FROM sc WHERE score > 0)
SELECT * EXCLUDE (rn) FROM r ORDER BY rn > 8, score DESC, note_id LIMIT {limit}"""


@query("t_hybrid_search", _hybrid_sql("the erhe", R.search_terms("the erhe"), R.match_terms("the erhe"), 50))
def _(s, d):
    return R.hybrid_search(V.notes(s, d), V.index(s, d, "notes"), "the erhe", 50)


@query("t_index_notes", "SELECT note_id AS id, 'content' AS field, unnest(regexp_extract_all(strip_accents(lower(content)), '[\\p{L}\\p{N}]+')) AS term FROM notes".join(["SELECT id, field, term, count(*) AS tf FROM (", ") GROUP BY ALL"]))
def _(s, d):
    return R.postings(V.notes(s, d), "note_id", "content")


@query("t_score_block", "SELECT note_id, CAST(CASE WHEN contains(x, 'theer') THEN 12 + o WHEN o > 0 THEN 4 + o ELSE 0 END AS DOUBLE) AS score FROM (SELECT *, least(4, (length(x) - length(replace(x, 'th', ''))) // 2) + least(4, (length(x) - length(replace(x, 'ee', ''))) // 2) AS o FROM norm)")
def _(s, d):
    return V.notes(s, d).select("note_id", R.score_block("theer", ["th", "ee"], "content").cast("double").alias("score"))


@query("t_score_note", "SELECT note_id, CAST(CASE WHEN contains(x, 'ther') THEN 13.5 WHEN contains(x, 'th') OR contains(x, 'en') THEN 5.5 END AS DOUBLE) + CASE WHEN contains(xt, 'th') THEN 5 ELSE 0 END + CASE WHEN contains(xt, 'en') THEN 5 ELSE 0 END + CASE WHEN contains(xc, 'th') THEN 3 ELSE 0 END + CASE WHEN contains(xc, 'en') THEN 3 ELSE 0 END + least(4, (length(x) - length(replace(x, 'th', ''))) // 2) + least(4, (length(x) - length(replace(x, 'en', ''))) // 2) AS s FROM norm".join(["SELECT note_id, coalesce(s, 0.0) AS score FROM (", ")"]))
def _(s, d):
    n = R.normalized(V.notes(s, d).withColumn("relevance", F.lit(1.5)), "title", "chapter", "content")
    return n.select("note_id", R.score_candidate("ther", ["th", "en"], "_content", ("_title", 5.0), ("_chapter", 3.0)).cast("double").alias("score"))


@query("u_dedup_evidence", "SELECT note_id FROM (SELECT note_id, row_number() OVER (PARTITION BY book_id, note_type, substring(trim(content), 1, 80) ORDER BY note_id) AS rn FROM notes) WHERE rn = 1")
def _(s, d):
    return R.dedup_evidence(V.notes(s, d), "book_id", "note_type", "content", F.asc("note_id")).select("note_id")


@query("a_peak_normalize", "SELECT doc_id, round(greatest(0, least(1, n_chars / max(n_chars) OVER ())), 9) AS score FROM documents", base=False)
def _(s, d):
    x = V.table(s, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return R.peak_normalize(x, "score").withColumn("score", F.round("score", 9))


@query("w_per_book_cap", "SELECT note_id FROM (SELECT note_id, created, row_number() OVER (PARTITION BY book_id ORDER BY created DESC, note_id) AS rn FROM notes) ORDER BY rn > 8, created DESC, note_id LIMIT 100")
def _(s, d):
    return R.diverse(V.notes(s, d).select("note_id", "book_id", "created"), "book_id", 8, 100, F.desc("created"), F.asc("note_id")).select("note_id")


# ---- graphs ---------------------------------------------------------------

EMB = "WITH e AS (SELECT 'src' || (vec_id % 20) AS book_id, embedding AS v FROM embeddings), m AS (SELECT book_id, list(m ORDER BY i) AS mean FROM (SELECT book_id, i, avg(v[i]::DOUBLE) AS m FROM e, range(1, 65) t(i) GROUP BY 1, 2) GROUP BY 1)"


@query("a_mean_vector", EMB + " SELECT book_id, round(list_sum(mean), 6) AS total FROM m", base=False)
def _(s, d):
    return G.mean_vectors(V.note_embeddings(s, d)).select("book_id", F.round(F.aggregate("mean", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


NEAR = """, tm AS (SELECT book_id, list(m ORDER BY i) AS mean FROM (SELECT 'src' || (vec_id % 20) AS book_id, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) WHERE vec_id % 4 = 0 GROUP BY 1, 2) GROUP BY 1),
x AS (SELECT a.book_id AS a, b.book_id AS b, round(list_cosine_similarity(a.mean, b.mean), 6) AS score FROM m a JOIN m b ON a.book_id < b.book_id),
y AS (SELECT a.book_id AS a, b.book_id AS b, round(list_cosine_similarity(a.mean, b.mean), 6) AS score FROM tm a JOIN tm b ON a.book_id < b.book_id)
SELECT 'semantic:' || a || ':' || b AS id, a, b, score, CASE WHEN score >= 0.72 THEN 'much alike' WHEN score >= 0.52 THEN 'alike' ELSE 'perhaps related' END AS relation FROM x WHERE score >= -0.3
UNION ALL SELECT 'semantic:thought:' || a || ':' || b, a, b, score, 'readers'' thoughts' FROM y WHERE score >= 0.1"""


@query("g_semantic", EMB + NEAR, base=False)
def _(s, d):
    return G.semantic_relations(V.note_embeddings(s, d), -0.3, 0.1)


@query("g_author", "SELECT a.book_id AS a, b.book_id AS b, a.author, 0.92::DOUBLE AS score FROM books a JOIN books b ON a.author = b.author AND a.book_id < b.book_id WHERE NOT (CAST(substring(a.book_id, 4) AS BIGINT) % 5 = 0 AND CAST(substring(b.book_id, 4) AS BIGINT) % 5 = 0)")
def _(s, d):
    from .kept import _work_titles

    return G.author_edges(_work_titles(V.books(s, d))).select("a", "b", "author", F.col("score").cast("double").alias("score"))


META = """WITH m AS (SELECT 'p' || p_partkey AS book_id, [' ' || upper(p_brand)] AS authors, [p_type, list_last(string_split(p_name, ' ')), p_brand, ' '] AS subjects, CASE WHEN p_partkey % 3 = 0 THEN ['Tr ' || p_size] WHEN p_partkey % 3 = 1 THEN ['Tr ' || p_size, 'B' || p_size] ELSE [] END AS translators FROM part),
k AS (SELECT DISTINCT book_id, kind, lower(trim(label)) AS label FROM (SELECT book_id, 'author' AS kind, unnest(authors) AS label FROM m UNION ALL SELECT book_id, 'subject', unnest(subjects) FROM m UNION ALL SELECT book_id, 'translator', unnest(translators) FROM m) WHERE trim(label) <> ''),
x AS (SELECT a.book_id AS a, b.book_id AS b, a.kind, list(a.label ORDER BY a.label)[1:6] AS labels FROM k a JOIN k b ON a.kind = b.kind AND a.label = b.label AND a.book_id < b.book_id GROUP BY 1, 2, 3)
SELECT a, b, kind, CASE kind WHEN 'author' THEN 0.94 WHEN 'translator' THEN 0.9 ELSE least(0.88, round(0.48 + 0.08 * len(labels), 6)) END::DOUBLE AS score, labels FROM x"""


@query("g_metadata", META, base=False, lists=("labels",))
def _(s, d):
    m, k = V.table(s, d, "part"), F.col("p_partkey") % 3
    raw = F.when(k == 0, F.concat(F.lit('["Tr '), F.col("p_size").cast("string"), F.lit('"]'))).when(k == 1, F.concat(F.lit("Tr "), F.col("p_size").cast("string"), F.lit("、 B"), F.col("p_size").cast("string"), F.lit("/ ")))
    meta = m.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("book_id"), F.array(F.concat(F.lit(" "), F.upper("p_brand"))).alias("authors"), F.array("p_type", F.element_at(F.split("p_name", " "), -1), "p_brand", F.lit(" ")).alias("subjects"), T.translators(raw).alias("translators"))
    return G.metadata_edges(meta).select("a", "b", "kind", F.col("score").cast("double").alias("score"), "labels")


INTRO = """WITH t AS (SELECT 'd' || doc_id AS book_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS x FROM documents WHERE length(text) >= 40),
g AS (SELECT book_id, list_distinct(list_transform(range(1, length(x)), lambda i: substring(x, i, 2))) AS g FROM t),
p AS (SELECT book_id, len(g) AS size, unnest(g) AS k FROM g), kk AS (SELECT k FROM p GROUP BY 1 HAVING count(*) BETWEEN 2 AND 60),
q AS (SELECT a.book_id AS a, b.book_id AS b, a.size AS sa, b.size AS sb, count(*) AS n FROM p a JOIN p b ON a.k = b.k AND a.book_id < b.book_id WHERE a.k IN (FROM kk) GROUP BY ALL)
SELECT a, b, n, round(least(0.92, n / sqrt(sa::DOUBLE * sb::DOUBLE)), 6) AS score FROM q WHERE n >= 4 AND n / sqrt(sa::DOUBLE * sb::DOUBLE) >= 0.18"""


@query("g_intro", INTRO, base=False)
def _(s, d):
    return G.intro_edges(V.intros(s, d))


LEX = """, w AS (SELECT book_id, unnest(regexp_extract_all(lower(content), '[\\p{L}]{3,}')) AS term, CASE WHEN note_type = 'thought' THEN 2.2 ELSE 1.0 END AS w FROM notes),
tf AS (SELECT book_id, term, sum(w::DOUBLE) AS tf FROM w GROUP BY 1, 2), nb AS (SELECT count(DISTINCT book_id) AS n FROM notes),
df AS (SELECT term, count(*) AS df FROM tf, nb GROUP BY term, n HAVING count(*) < 0.45 * n),
ww AS (SELECT book_id, term, round((1 + ln(round(tf, 6))) * ln(1 + n::DOUBLE / df), 9) AS weight FROM tf JOIN df USING (term), nb),
wt AS (SELECT book_id, term, weight FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY weight DESC, term) AS rn FROM ww) WHERE rn <= 120)
"""


def _weights(s: SparkSession, d: str) -> DataFrame:
    n = V.notes(s, d)
    w = n.select("book_id", F.explode(F.regexp_extract_all(F.lower("content"), F.lit(r"\p{L}{3,}"), F.lit(0))).alias("term"), F.when(F.col("note_type") == "thought", 2.2).otherwise(1.0).alias("w"))
    tf = w.groupBy("book_id", "term").agg(F.round(F.sum("w"), 6).alias("w"))
    return L.settle(G.term_weights(tf, n.select("book_id").distinct().count()))


@query("g_lexical", LEX + ", nn AS (SELECT book_id, sqrt(sum(weight * weight)) AS norm FROM wt GROUP BY 1), tt AS (SELECT term FROM wt GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50), pp AS (SELECT a.book_id AS a, b.book_id AS b, sum(a.weight * b.weight) AS dot, count(*) AS shared FROM wt a JOIN wt b ON a.term = b.term AND a.book_id < b.book_id WHERE a.term IN (FROM tt) GROUP BY 1, 2) SELECT a, b, shared, round(dot / (x.norm * y.norm), 6) AS score FROM pp JOIN nn x ON x.book_id = a JOIN nn y ON y.book_id = b WHERE round(dot / (x.norm * y.norm), 6) >= 0.02 AND shared >= 2")
def _(s, d):
    return G.lexical_edges(_weights(s, d))


@query("a_degree", "SELECT node, count(*) AS degree FROM (SELECT a.book_id AS node FROM books a JOIN books b ON a.author = b.author AND a.book_id < b.book_id UNION ALL SELECT b.book_id FROM books a JOIN books b ON a.author = b.author AND a.book_id < b.book_id) GROUP BY 1")
def _(s, d):
    return G.degree(G.author_edges(V.books(s, d), works_too=True))


DEGREE = EMB.replace("WITH e", "WITH RECURSIVE e") + """, x AS (SELECT a.book_id AS a, b.book_id AS b, round(list_cosine_similarity(a.mean, b.mean), 6) AS score FROM m a JOIN m b ON a.book_id < b.book_id),
o AS (SELECT *, row_number() OVER (ORDER BY score DESC, a, b) AS i FROM x),
st AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS used UNION ALL SELECT o.i, CASE WHEN len(list_filter(used, lambda u: u = a)) < 12 AND len(list_filter(used, lambda u: u = b)) < 12 THEN used || [a, b] ELSE used END FROM st JOIN o ON o.i = st.i + 1)
SELECT a, b, score FROM (SELECT i, len(used) > lag(len(used)) OVER (ORDER BY i) AS kept FROM st) JOIN o USING (i) WHERE kept"""


@query("w_degree_cap", DEGREE, base=False)
def _(s, d):
    return G.degree_cap(G.semantic_edges(V.note_embeddings(s, d), -1.0), 12)


# ---- ingestion ------------------------------------------------------------


@query("e_classify", """SELECT page_id, CASE WHEN trim(title) = '' THEN 'empty_title' WHEN redirect THEN 'redirect' WHEN page_id % 11 = 0 THEN 'soft_redirect' WHEN contains(summary, 'COPPER') THEN 'disambiguation' WHEN ends_with(title, 'list') THEN 'list_page' WHEN trim(text) = '' THEN 'empty' WHEN length(trim(text)) < 12 THEN 'too_short' ELSE 'accepted' END AS outcome
FROM (SELECT p_partkey AS page_id, CASE WHEN p_partkey % 29 = 0 THEN '  ' WHEN p_partkey % 9 = 0 THEN lower(p_name) || ' list' ELSE lower(p_name) END AS title, p_partkey % 4 = 1 AS redirect, p_type AS summary, CASE WHEN p_partkey % 7 = 0 THEN ' ' WHEN p_partkey % 5 = 0 THEN substring(p_type, 1, 9) ELSE p_type END AS text FROM part)""", base=False)
def _(s, d):
    p, k = V.table(s, d, "part"), F.col("p_partkey")
    title = F.when(k % 29 == 0, "  ").when(k % 9 == 0, F.concat(F.lower("p_name"), F.lit(" list"))).otherwise(F.lower("p_name"))
    text = F.when(k % 7 == 0, " ").when(k % 5 == 0, F.substring("p_type", 1, 9)).otherwise(F.col("p_type"))
    return p.select(k.alias("page_id"), I.classify(title, F.when(k % 4 == 1, k), text, F.contains("p_type", F.lit("COPPER")), F.endswith(title, F.lit("list")), k % 11 == 0).alias("outcome"))


REDIRECTS = """WITH RECURSIVE pg AS (SELECT p_partkey AS id, p_name || '_' || p_partkey AS title, CASE WHEN p_partkey % 4 <> 0 THEN (p_partkey * 3 + 1) % (SELECT count(*) FROM part) END AS target FROM part),
w AS (SELECT id AS page_id, target AS here, [target] AS seen, 0 AS i, NULL::VARCHAR AS outcome FROM pg WHERE target IS NOT NULL
  UNION ALL SELECT page_id, CASE WHEN o IS NULL THEN next ELSE here END, CASE WHEN o IS NULL THEN list_append(seen, next) ELSE seen END, i + 1, o
  FROM (SELECT w.*, pg.target AS next, CASE WHEN pg.target IS NULL THEN 'ok' WHEN i = 10 THEN 'too_deep' WHEN list_contains(seen, pg.target) THEN 'loop' END AS o FROM w LEFT JOIN pg ON pg.id = w.here WHERE w.outcome IS NULL)),
ends AS (SELECT page_id, here AS final, CASE WHEN outcome = 'ok' AND here NOT IN (SELECT id FROM pg) THEN 'broken' ELSE outcome END AS outcome FROM w WHERE outcome IS NOT NULL) """


@query("e_redirects", REDIRECTS + "SELECT * FROM ends", base=False)
def _(s, d):
    return I.resolve_redirects(V.wiki_pages(s, d).select("page_id", "target"))


@query("e_publish", "SELECT s.page_id, s.title, CASE WHEN o.page_id IS NULL THEN 'insert' WHEN o.page_id <> s.page_id THEN 'conflict' WHEN o.hash = s.hash THEN 'skip' WHEN o.edited THEN 'snapshot' ELSE 'update' END AS action FROM (SELECT p_partkey AS page_id, p_name || '_' || (p_partkey // 2) AS title, md5(p_type) AS hash FROM part) s LEFT JOIN (SELECT p_partkey AS page_id, p_name || '_' || (p_partkey // 2) AS title, md5(CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE '' END || p_type) AS hash, p_partkey % 6 = 0 AS edited FROM part WHERE p_partkey % 5 < 3) o ON o.title = s.title", base=False)
def _(s, d):
    p = V.table(s, d, "part")
    title = F.concat("p_name", F.lit("_"), F.floor(F.col("p_partkey") / 2).cast("string")).alias("title")
    staged = p.select(F.col("p_partkey").alias("page_id"), title, F.md5("p_type").alias("hash"))
    old = p.where("p_partkey % 5 < 3").select(F.col("p_partkey").alias("page_id"), title, F.md5(F.concat(F.when(F.col("p_partkey") % 3 == 0, "x").otherwise(""), F.col("p_type"))).alias("hash"), (F.col("p_partkey") % 6 == 0).alias("edited"))
    return I.publish(old, staged)


PUBLISHED = """, st AS (SELECT p_partkey AS page_id, p_name || '_' || (p_partkey // 2) AS title, md5(p_type) AS hash, p_type AS text FROM part),
od AS (SELECT title, page_id, md5(was) AS hash, page_id % 6 = 0 AS edited, was || CASE WHEN page_id % 6 = 0 THEN ' mine' ELSE '' END AS text, was AS snapshot FROM (SELECT p_partkey AS page_id, p_name || '_' || (p_partkey // 2) AS title, CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE '' END || p_type AS was FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 5 < 3)),
j AS (SELECT o.*, s.hash AS nh, s.text AS nt FROM od o LEFT JOIN st s ON s.title = o.title AND s.page_id = o.page_id)
SELECT 'term' AS part, title, page_id, coalesce(nh, hash) AS hash, edited, CASE WHEN nh <> hash AND NOT edited THEN nt ELSE text END AS text, CASE WHEN nh <> hash THEN nt ELSE snapshot END AS snapshot FROM j
UNION ALL SELECT 'term', title, page_id, hash, FALSE, text, text FROM st WHERE title NOT IN (SELECT title FROM od)
UNION ALL SELECT 'conflict', s.title, s.page_id, '', FALSE, o.page_id::VARCHAR, '' FROM st s JOIN od o ON o.title = s.title AND o.page_id <> s.page_id"""


@query("e_publish_applied", "WITH z AS (SELECT 1)" + PUBLISHED, base=False)
def _(s, d):
    p, k = V.table(s, d, "part"), F.col("p_partkey")
    title = F.concat("p_name", F.lit("_"), F.floor(k / 2).cast("string")).alias("title")
    staged = p.select(k.alias("page_id"), title, F.md5("p_type").alias("hash"), F.col("p_type").alias("text"))
    was = F.concat(F.when(k % 3 == 0, "x").otherwise(""), F.col("p_type"))
    stored = p.where((k % 2 == 0) & (k % 5 < 3)).select(title, k.alias("page_id"), F.md5(was).alias("hash"), (k % 6 == 0).alias("edited"), F.concat(was, F.when(k % 6 == 0, " mine").otherwise("")).alias("text"), was.alias("snapshot"))
    terms, conflicts = I.apply_publish(stored, staged)
    blank = F.lit("")
    return terms.select(F.lit("term").alias("part"), "title", "page_id", "hash", "edited", "text", "snapshot").union(conflicts.select(F.lit("conflict"), "title", "page_id", blank, F.lit(False), F.col("old_page").cast("string"), blank))


CHUNKS = """WITH RECURSIVE w AS (SELECT doc_id AS id, text, 0::BIGINT AS here, 0 AS i, NULL::VARCHAR AS content FROM documents WHERE length(text) > 0
  UNION ALL SELECT id, text, CASE WHEN s >= length(text) OR s - here <= 150 THEN s ELSE s - 150 END, i + 1, regexp_replace(substring(text, here + 1, s - here), '^\\s+|\\s+$', '', 'g')
  FROM (SELECT id, text, here, i, CASE WHEN q > 0 AND length(p) - q + 1 >= 2 THEN here + length(p) - q + 1 ELSE least(length(text), here + 1200) END AS s
        FROM (SELECT *, instr(reverse(p), chr(10)) AS q FROM (SELECT id, text, here, i, substring(text, here + 1, 1200) AS p FROM w WHERE here < length(text)))))
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS INTEGER) AS position, content FROM w WHERE content <> ''"""


@query("e_chunk", CHUNKS, base=False)
def _(s, d):
    return I.chunks(V.table(s, d, "documents"), "doc_id", "text")


