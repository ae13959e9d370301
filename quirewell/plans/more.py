"""Further queries: lookups, maintenance, windows, concept graphs and publishing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import ingest as I
from ..operators import library as L
from ..operators import retrieval as R
from ..operators import search as S
from ..operators import wikitext as W
from ..sources import documents as D
from ..sources import views as V
from .catalog import EMB, LEX, REDIRECTS, _listed, _weights, query
from .found import MORE


@query("m_book_detail", "SELECT book_id, title, highlight_count, thought_count, reading_status FROM listed WHERE book_id = 'src7'")
def _(s, d):
    return _listed(s, d).where("book_id = 'src7'").select("book_id", "title", "highlight_count", "thought_count", "reading_status")


@query("m_notes_filter", "SELECT note_id FROM notes WHERE note_type = 'thought' AND (contains(lower(content), 'tion') OR contains(lower(title), 'tion') OR contains(lower(chapter), 'tion'))")
def _(s, d):
    hit = T.contains_folded(F.col("content"), "tion") | T.contains_folded(F.col("title"), "tion") | T.contains_folded(F.col("chapter"), "tion")
    return V.notes(s, d).where((F.col("note_type") == "thought") & hit).select("note_id")


@query("m_metadata_filter", "SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%an%' OR lower(p_brand) LIKE '%an%' ORDER BY p_partkey LIMIT 20 OFFSET 5", base=False)
def _(s, d):
    return V.table(s, d, "part").where(L.like_any("an", "p_name", "p_brand")).orderBy("p_partkey").select("p_partkey").offset(5).limit(20)


@query("j_chapter_lookup", "SELECT note_id, coalesce(i, 0) AS chapter_idx, coalesce(t, '') AS chapter_title FROM all_notes LEFT JOIN (VALUES ('en', 1, 'English'), ('fr', 2, 'French')) c(k, i, t) ON c.k = chapter")
def _(s, d):
    c = s.createDataFrame([("en", 1, "English"), ("fr", 2, "French")], "chapter string, chapter_idx int, t string")
    return V.all_notes(s, d).join(F.broadcast(c), "chapter", "left").select("note_id", F.coalesce("chapter_idx", F.lit(0)).alias("chapter_idx"), F.coalesce("t", F.lit("")).alias("chapter_title"))


@query("m_isbn_pick", "SELECT p_brand, coalesce(min(CASE WHEN p_size > 25 THEN '978' || p_partkey END), min(CASE WHEN p_size <= 25 THEN '0' || p_partkey END), '') AS isbn FROM part GROUP BY 1", base=False)
def _(s, d):
    p, key = V.table(s, d, "part"), F.col("p_partkey").cast("string")
    long, short = F.when(F.col("p_size") > 25, F.concat(F.lit("978"), key)), F.when(F.col("p_size") <= 25, F.concat(F.lit("0"), key))
    return p.groupBy("p_brand").agg(F.coalesce(F.min(long), F.min(short), F.lit("")).alias("isbn"))


@query("m_backfill_metadata", "SELECT book_id, title FROM books WHERE NOT is_deleted AND book_id NOT IN (SELECT 'src' || p_partkey FROM part WHERE p_partkey % 2 = 0)")
def _(s, d):
    have = V.table(s, d, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("src"), F.col("p_partkey").cast("string")).alias("book_id"))
    return V.books(s, d).where("NOT is_deleted").join(have, "book_id", "left_anti").select("book_id", "title")


@query("l_has_more", "SELECT note_id, (SELECT count(*) FROM notes) > 25 AS has_more FROM notes ORDER BY created DESC, note_id LIMIT 25")
def _(s, d):
    # one row more than the page tells whether there is another page
    first = V.notes(s, d).select("note_id", "created").orderBy(F.desc("created"), "note_id").limit(26)
    ranked = first.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("created"), "note_id")))
    return ranked.withColumn("has_more", F.max("rn").over(Window.partitionBy()) > 25).where("rn <= 25").select("note_id", "has_more")


@query("u_neighbors", "SELECT DISTINCT CASE WHEN a.book_id = 'src3' THEN b.book_id ELSE a.book_id END AS node FROM books a JOIN books b ON a.author = b.author AND a.book_id < b.book_id WHERE a.book_id = 'src3' OR b.book_id = 'src3'")
def _(s, d):
    e = G.author_edges(V.books(s, d), works_too=True)
    return e.where("a = 'src3'").select(F.col("b").alias("node")).union(e.where("b = 'src3'").select("a")).distinct()


@query("u_entity_union", "SELECT 'book' AS kind, book_id AS id FROM books WHERE NOT is_deleted UNION ALL SELECT note_type, note_id FROM notes UNION ALL SELECT 'source', 'w' || page_id FROM pages")
def _(s, d):
    b = V.books(s, d).where("NOT is_deleted").select(F.lit("book").alias("kind"), F.col("book_id").alias("id"))
    n = V.notes(s, d).select(F.col("note_type").alias("kind"), F.col("note_id").alias("id"))
    p = V.table(s, d, "pages").select(F.lit("source").alias("kind"), F.concat(F.lit("w"), F.col("page_id").cast("string")).alias("id"))
    return b.unionByName(n).unionByName(p)


@query("u_edge_merge", "SELECT k, src FROM (SELECT k, src, row_number() OVER (PARTITION BY k ORDER BY src DESC) AS rn FROM (SELECT o_custkey % 50 AS k, 1 AS src FROM orders UNION ALL SELECT o_custkey % 70, 2 FROM orders)) WHERE rn = 1", base=False)
def _(s, d):
    o = V.table(s, d, "orders")
    x = o.select((F.col("o_custkey") % 50).alias("k"), F.lit(1).alias("src")).union(o.select(F.col("o_custkey") % 70, F.lit(2)))
    return L.latest(x, ["k"], F.desc("src"))


@query("j_title_conflict", "SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_partkey < b.p_partkey AND a.p_brand <> b.p_brand", base=False)
def _(s, d):
    return G.conflicts(V.table(s, d, "part"), "p_name", "p_partkey", "p_brand")


@query("j_not_in_hidden", "SELECT a.book_id AS a, b.book_id AS b FROM books a JOIN books b ON a.author = b.author AND a.book_id < b.book_id WHERE NOT a.is_deleted AND NOT b.is_deleted")
def _(s, d):
    books = V.books(s, d)
    hidden = books.where("is_deleted").select("book_id")
    e = G.author_edges(books, works_too=True).select("a", "b")
    return e.join(hidden.toDF("a"), "a", "left_anti").join(hidden.toDF("b"), "b", "left_anti").select("a", "b")


@query("w_per_book_quota", "SELECT note_id FROM (SELECT note_id, row_number() OVER (PARTITION BY book_id ORDER BY created DESC, note_id) AS rn FROM notes) WHERE rn <= 3")
def _(s, d):
    return L.top_per_group(V.notes(s, d).select("note_id", "book_id", "created"), "book_id", 3, F.desc("created"), F.asc("note_id")).select("note_id")


@query("a_df", LEX + "SELECT term, count(*) AS df FROM tf GROUP BY 1")
def _(s, d):
    n = V.notes(s, d)
    w = n.select("book_id", F.explode(F.regexp_extract_all(F.lower("content"), F.lit(r"\p{L}{3,}"), F.lit(0))).alias("term")).distinct()
    return w.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


@query("a_l2_norm", LEX + "SELECT book_id, round(sqrt(sum(weight * weight)), 6) AS norm FROM wt GROUP BY 1")
def _(s, d):
    return _weights(s, d).groupBy("book_id").agg(F.round(F.sqrt(F.sum(F.col("weight") * F.col("weight"))), 6).alias("norm"))


@query("a_text_quality", "SELECT doc_id, n > 0 AND ((n - bad - ctl) / n < 0.80 OR bad / n > 0.05 OR ctl / n > 0.10) AS garbled FROM (SELECT doc_id, length(x)::DOUBLE AS n, length(x) - length(replace(x, chr(65533), '')) AS bad, length(x) - length(regexp_replace(x, '[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')) AS ctl FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN replace(text, 'e', chr(65533)) WHEN 1 THEN translate(text, 'aio', repeat(chr(1), 3)) ELSE text END AS x FROM documents))", base=False)
def _(s, d):
    k = F.col("doc_id") % 5
    text = F.when(k == 0, F.replace("text", F.lit("e"), F.lit("�"))).when(k == 1, F.translate("text", "aio", "\x01\x01\x01")).otherwise(F.col("text"))  # replaced and control characters as of a bad extraction
    return V.table(s, d, "documents").select("doc_id", D.garbled(text).alias("garbled"))


@query("a_reading_stats", "SELECT event_type, CAST((date_part('hour', ts) + 6) % 24 AS INTEGER) AS hour, round(sum(value) / 60, 4) AS minutes FROM events GROUP BY 1, 2", base=False)
def _(s, d):
    return V.table(s, d, "events").groupBy("event_type", ((F.hour("ts") + 6) % 24).cast("int").alias("hour")).agg(F.round(F.sum("value") / 60, 4).alias("minutes"))


RECENT = "strftime(make_timestamp({} * 1000000), '%Y-%m-%d %H:%M:%S')"


@query("t_recent", MORE + f""", h AS (SELECT note_id AS id, note_type AS entity_type, book_id, title, {RECENT.format('created')} AS updated_at, row_number() OVER (PARTITION BY note_type ORDER BY created DESC, note_id) AS rn FROM notes),
b AS (SELECT book_id AS id, 'book' AS entity_type, book_id, title, {RECENT.format('updated')} AS updated_at, row_number() OVER (ORDER BY updated DESC, book_id) AS rn FROM sbooks),
s AS (SELECT id, 'source' AS entity_type, '' AS book_id, title, {RECENT.format('updated')} AS updated_at, row_number() OVER (ORDER BY updated DESC, id) AS rn FROM srcs),
a AS (SELECT * FROM h UNION ALL SELECT * FROM b UNION ALL SELECT * FROM s)
SELECT 'all' AS view, id, entity_type, book_id, updated_at FROM (SELECT * FROM a WHERE rn <= 36 ORDER BY updated_at DESC, title, id LIMIT 30 OFFSET 5)
UNION ALL SELECT 'book', id, entity_type, book_id, updated_at FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY updated_at DESC, id) AS r FROM a WHERE book_id = 'src3' AND entity_type IN ('book', 'thought')) WHERE r <= 11 ORDER BY updated_at DESC, title, id LIMIT 10)""")
def _(s, d):
    notes, books, sources = V.notes(s, d), V.search_books(s, d), V.sources(s, d)
    view = lambda name, rows: rows.select(F.lit(name).alias("view"), "id", "entity_type", "book_id", "updated_at")
    return view("all", S.recent(notes, books, sources, None, None, 30, 5)).union(view("book", S.recent(notes, books, sources, ["book", "thought"], "src3", 10)))


@query("fn_core_title", "SELECT p_partkey, trim(regexp_extract(p_name || ' (' || p_brand || ')', '^([^(]*)', 1)) AS title FROM part", base=False)
def _(s, d):
    return V.table(s, d, "part").select("p_partkey", T.core_title(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("title"))


@query("fn_isbn_norm", "SELECT p_partkey, CASE WHEN length(x) = 10 THEN x END AS isbn10, CASE WHEN length(x) = 13 THEN x END AS isbn13 FROM (SELECT p_partkey, upper(regexp_replace('978-' || lpad(p_partkey::VARCHAR, CASE WHEN p_partkey % 2 = 0 THEN 10 ELSE 7 END, '0') || '-', '[^0-9A-Za-z]', '', 'g')) AS x FROM part)", base=False)
def _(s, d):
    key = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("978-"), F.when(F.col("p_partkey") % 2 == 0, F.lpad(key, 10, "0")).otherwise(F.lpad(key, 7, "0")), F.lit("-"))
    ten, thirteen = T.isbn(text)
    return V.table(s, d, "part").select("p_partkey", ten.alias("isbn10"), thirteen.alias("isbn13"))


@query("fn_normalize_name", "SELECT item_id, substring(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 40) AS name FROM benchmark", base=False)
def _(s, d):
    return V.table(s, d, "benchmark").select("item_id", T.normalize_name(F.col("text")).alias("name"))


EVIDENCE = EMB + """, x AS (SELECT a.book_id AS a, b.book_id AS b FROM m a JOIN m b ON a.book_id < b.book_id WHERE round(list_cosine_similarity(a.mean, b.mean), 6) >= 0.1),
p AS (SELECT a AS book_id, b AS other FROM x UNION ALL SELECT b, a FROM x),
n AS (SELECT 'src' || (vec_id % 20) AS book_id, 'v' || vec_id AS note_id, embedding::DOUBLE[] AS v FROM embeddings),
r AS (SELECT book_id, other, note_id, round(list_cosine_similarity(v, mean), 9) AS near FROM n JOIN p USING (book_id) JOIN (SELECT book_id AS other, mean FROM m) USING (other))
SELECT book_id, other, arg_min(note_id, (-near, note_id)) AS note_id FROM r GROUP BY 1, 2"""


@query("w_best_evidence", EVIDENCE, base=False)
def _(s, d):
    e = V.note_embeddings(s, d)
    return G.best_evidence(e, G.semantic_edges(e, 0.1))


@query("e_aliases", REDIRECTS + "SELECT final AS page_id, string_agg(DISTINCT r.title, '|' ORDER BY r.title) AS aliases FROM ends JOIN pg r ON r.id = ends.page_id JOIN pg f ON f.id = final WHERE outcome = 'ok' AND r.title <> f.title GROUP BY 1", base=False)
def _(s, d):
    w = V.wiki_pages(s, d)
    found = I.aliases(w.select("page_id", F.col("raw_title").alias("title")), I.resolve_redirects(w.select("page_id", "target")))
    return found.select("page_id", F.array_join("aliases", "|").alias("aliases"))


@query("e_validate_batch", """WITH st AS (SELECT p_partkey % 5 AS job_id, p_partkey AS page_id, p_name || '_' || p_partkey AS title, CASE p_partkey % 7 WHEN 0 THEN 'redirect' WHEN 1 THEN 'too_short' WHEN 2 THEN 'list_page' ELSE 'accepted' END AS outcome FROM part),
te AS (SELECT p_name || '_' || p_partkey AS term, CASE WHEN p_partkey % 3 = 0 THEN 'manual' ELSE 'encyclopedia' END AS source, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN p_partkey ELSE p_partkey + 1 END AS page_id FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 1),
j AS (SELECT st.*, te.source, te.page_id AS t FROM st LEFT JOIN te ON te.term = st.title),
c AS (SELECT job_id, count(*) FILTER (outcome = 'accepted') AS accepted, count(*) FILTER (outcome = 'redirect') AS redirects, count(*) FILTER (outcome NOT IN ('accepted', 'redirect')) AS filtered,
 count(*) FILTER (outcome = 'accepted' AND source IS NOT NULL AND (source <> 'encyclopedia' OR t IS NULL OR t <> page_id)) AS title_conflicts, count(*) FILTER (outcome = 'redirect' AND source = 'encyclopedia' AND t <> page_id) AS alias_conflicts FROM j GROUP BY 1)
SELECT *, greatest(0, accepted - title_conflicts) AS publishable FROM c""", base=False)
def _(s, d):
    p, k = V.table(s, d, "part"), F.col("p_partkey")
    title = F.concat("p_name", F.lit("_"), k.cast("string"))
    outcome = F.when(k % 7 == 0, "redirect").when(k % 7 == 1, "too_short").when(k % 7 == 2, "list_page").otherwise("accepted")
    staging = p.select((k % 5).alias("job_id"), k.alias("page_id"), title.alias("title"), outcome.alias("outcome"))
    page = F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, k).otherwise(k + 1)
    terms = p.where((k % 2 == 0) | (k % 3 == 1)).select(title.alias("term"), F.when(k % 3 == 0, "manual").otherwise("encyclopedia").alias("source"), page.alias("page_id"))
    return I.validate_batch(staging, terms)


@query("e_title", "SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages", base=False)
def _(s, d):
    return V.table(s, d, "pages").select("page_id", D.html_title(F.col("html")).alias("title"))


@query("e_html_strip")
def _(s, d):
    return D.html_documents(V.table(s, d, "pages"))


@query("snk_report", "SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS high, min(event_id) AS example FROM events GROUP BY 1", base=False)
def _(s, d):
    return V.table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("high"), F.min("event_id").alias("example"))


@query("st_tumbling_counts", "SELECT date_trunc('day', ts) AS start, event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1, 2", base=False)
def _(s, d):
    w = F.window(F.col("ts"), "1 day")
    return V.table(s, d, "events").groupBy(w.alias("w"), "event_type").agg(F.count_distinct("event_id").alias("n")).select("w.start", "event_type", "n")


@query("e_summary")
def _(s, d):
    return W.summaries(V.table(s, d, "documents").select(F.col("doc_id").alias("page_id"), "text"))


READER = """WITH i AS (SELECT DISTINCT source AS id FROM documents UNION ALL SELECT p_partkey::VARCHAR FROM part),
p AS (SELECT id, md5(id) AS d, regexp_full_match(id, '[0-9]*') AS digits FROM i),
g AS (SELECT *, CASE WHEN digits THEN [lower(to_hex(TRY_CAST(substring(id, 9 * k + 1, 9) AS BIGINT))) FOR k IN range(0, (greatest(length(id), 1) + 8) // 9)] ELSE [array_to_string([lower(to_hex(ord(c))) FOR c IN string_split(id, '')], '')] END AS parts FROM p),
w AS (SELECT id, d, substring(d, 1, 3) || CASE WHEN digits THEN '3' ELSE '4' END || '2' || substring(d, 31, 2) || array_to_string([lpad(lower(to_hex(length(x))), 2, '0') || x FOR x IN parts], 'g') AS w FROM g),
z AS (SELECT id, w || substring(d, 1, greatest(0, 20 - length(w))) AS z FROM w)
SELECT id AS book_id, z || substring(md5(z), 1, 3) AS reader_id FROM z"""


@query("p_reader_id", READER, base=False)
def _(s, d):
    return V.books(s, d).select("book_id", T.reader_id(F.col("book_id")).alias("reader_id")).union(V.table(s, d, "part").select(F.col("p_partkey").cast("string"), T.reader_id(F.col("p_partkey").cast("string"))))
