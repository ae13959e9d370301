"""Queries of text functions, relations, maintenance and import jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import jobs as J
from ..operators import library as L
from ..operators import retrieval as R
from ..operators.search_index import SearchIndex
from ..sources import folders
from ..sources import views as V
from ..streaming import sync
from .catalog import query
from .found import MORE

GRAPH_WORDS = "regexp_extract_all(regexp_replace(lower({}), '[\\s\\p{{P}}\\p{{S}}\\d]+', ' ', 'g'), '[a-z]{{3,}}')"


def key_sql(title: str) -> str:
    """A title's key in SQL."""
    out = f"lower({title})"
    for what in (T.TITLE_MARKS, T.TITLE_NUMBERS, T.TITLE_EDITIONS):
        out = f"regexp_replace({out}, '{what}', '', 'g')"
    return out


#: Titles of a library in which every fifth book is a volume of one work.
WORK = "CASE WHEN CAST(substring({0}, 4) AS BIGINT) % 5 = 0 THEN '《同一部作品》第' || substring({0}, 4) || '卷' ELSE translate({1}, '0123456789', 'abcdefghij') END"


def _work_titles(books):
    return books.withColumn("title", F.when(F.substring("book_id", 4, 10).cast("bigint") % 5 == 0, F.concat(F.lit("《同一部作品》第"), F.substring("book_id", 4, 10), F.lit("卷"))).otherwise(F.translate("title", "0123456789", "abcdefghij")))


# ---- text functions -------------------------------------------------------


@query("fn_graph_words", f"SELECT note_id, {GRAPH_WORDS.format('content')} AS words FROM notes UNION ALL SELECT 'han', ['历史', '史书', 'abc']", lists=("words",))
def _(s, d):
    notes = V.notes(s, d).select("note_id", "content").union(s.createDataFrame([("han", "历史书，我们 abc 12ab")], "note_id string, content string"))
    return notes.select("note_id", T.graph_words(F.col("content")).alias("words"))


TITLES = """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '《' || p_name || '》典藏版' WHEN 1 THEN '【' || p_brand || '】' || p_name || ' 第三卷' WHEN 2 THEN p_name || '（全集）' WHEN 3 THEN '红楼梦·' || p_name || '：全' || p_size || '册' WHEN 4 THEN p_name || ' - ' || p_type ELSE p_name END AS title FROM part"""


def _titles(s, d):
    k, lit = F.col("p_partkey") % 6, F.lit
    t = F.when(k == 0, F.concat(lit("《"), "p_name", lit("》典藏版"))).when(k == 1, F.concat(lit("【"), "p_brand", lit("】"), "p_name", lit(" 第三卷"))).when(k == 2, F.concat("p_name", lit("（全集）")))
    t = t.when(k == 3, F.concat(lit("红楼梦·"), "p_name", lit("：全"), F.col("p_size").cast("string"), lit("册"))).when(k == 4, F.concat("p_name", lit(" - "), "p_type")).otherwise(F.col("p_name"))
    return V.table(s, d, "part").select("p_partkey", t.alias("title"))


@query("fn_title_key", f"SELECT p_partkey, {key_sql('title')} AS key FROM ({TITLES})", base=False)
def _(s, d):
    return _titles(s, d).select("p_partkey", T.title_key(F.col("title")).alias("key"))


@query("fn_same_work", f"WITH k AS (SELECT {key_sql('title')} AS k, count(*) AS n FROM ({TITLES}) GROUP BY 1) SELECT a.k AS a, b.k AS b, a.n AS books_a, b.n AS books_b FROM k a JOIN k b ON a.k < b.k AND least(length(a.k), length(b.k)) >= 4 AND (contains(a.k, b.k) OR contains(b.k, a.k))", base=False)
def _(s, d):
    return G.same_works(_titles(s, d).select(T.title_key(F.col("title")).alias("key")))


@query("fn_version_key", "SELECT p_partkey, CASE WHEN length(k) >= 3 THEN k END AS key FROM (SELECT p_partkey, split_part(regexp_replace(lower(CASE WHEN p_partkey % 3 = 0 THEN '《' || p_name || '》(' || p_brand || ')' WHEN p_partkey % 3 = 1 THEN p_name || '：' || p_brand ELSE 'Ab (x)' END), '[《》 ]', '', 'g').replace('（', '(').replace(':', '(').replace('：', '('), '(', 1) AS k FROM part)", base=False)
def _(s, d):
    k = F.col("p_partkey") % 3
    title = F.when(k == 0, F.concat(F.lit("《"), "p_name", F.lit("》("), "p_brand", F.lit(")"))).when(k == 1, F.concat("p_name", F.lit("："), "p_brand")).otherwise("Ab (x)")
    return V.table(s, d, "part").select("p_partkey", T.version_key(title).alias("key"))


@query("fn_search_key", "SELECT p_partkey, lower(trim(regexp_replace(replace(p_name || '_' || p_brand, '_', ' '), '\\s+', ' ', 'g'))) AS key FROM part", base=False)
def _(s, d):
    return V.table(s, d, "part").select("p_partkey", T.search_key(F.concat("p_name", F.lit("_"), "p_brand")).alias("key"))


@query("fn_split_subjects", "SELECT p_partkey, [p_type, p_brand, p_name, 'x'] AS subjects FROM part", base=False, lists=("subjects",))
def _(s, d):
    return V.table(s, d, "part").select("p_partkey", T.split_list(F.concat("p_type", F.lit("/ "), "p_brand", F.lit(",,"), "p_name", F.lit("、 ·x·"))).alias("subjects"))


@query("fn_split_translators", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN [p_brand, ' kept '] ELSE [p_brand, p_type] END AS names FROM part", base=False, lists=("names",))
def _(s, d):
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('["'), "p_brand", F.lit('"," kept "]'))).otherwise(F.concat("p_brand", F.lit("、 /"), "p_type"))
    return V.table(s, d, "part").select("p_partkey", T.translators(raw).alias("names"))


@query("fn_highlight_terms", """WITH q AS (SELECT item_id, list_filter(string_split_regex(substring(text, 1, 40), '\\s+'), lambda x: x <> '') AS w FROM benchmark),
p AS (SELECT item_id, w || flatten(list_transform(list_filter(list_transform(w, lambda x: regexp_replace(x, '[^\\p{L}\\p{N}]', '', 'g')), lambda x: length(x) > 2), lambda x: list_transform(range(1, length(x)), lambda i: substring(x, i, 2)))) AS t FROM q)
SELECT item_id, list_transform(list_sort(list_transform(range(1, len(t) + 1), lambda i: {'n': -length(t[i]), 'i': i})), lambda z: t[z.i]) AS terms FROM p""", base=False, lists=("terms",))
def _(s, d):
    return V.table(s, d, "benchmark").select("item_id", T.highlighted(F.substring("text", 1, 40)).alias("terms"))


@query("fn_first_line_title", "SELECT doc_id, substring(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: NOT regexp_full_match(regexp_replace(x, '\\s', '', 'g'), '[0-9]*|第[0-9页]*页'))[1], 1, 60) AS title FROM documents UNION ALL SELECT -1, 'The title'", base=False)
def _(s, d):
    rows = V.table(s, d, "documents").select("doc_id", "text").union(s.createDataFrame([(-1, " 12 \n第 3 页\n  The title \nmore")], "doc_id bigint, text string"))
    return rows.select("doc_id", T.first_line_title(F.col("text")).alias("title"))


@query("fn_clean_cjk_space", "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '中文' || p_name || ' 是' WHEN 1 THEN p_brand || '。' || p_name WHEN 2 THEN '一二三，四' || p_name WHEN 3 THEN p_name || ' ' || p_brand ELSE '书 a' || p_brand || '》' END AS text FROM part", base=False)
def _(s, d):
    k, lit = F.col("p_partkey") % 5, F.lit
    t = F.when(k == 0, F.concat(lit("中 文"), "p_name", lit(" 是"))).when(k == 1, F.concat("p_brand", lit(" 。"), "p_name")).when(k == 2, F.concat(lit("一 二  三 ， 四"), "p_name")).when(k == 3, F.concat("p_name", lit(" "), "p_brand")).otherwise(F.concat(lit("书 a"), "p_brand", lit(" 》")))
    return V.table(s, d, "part").select("p_partkey", T.clean_cjk_space(t).alias("text"))


@query("p_coalesce_fallback", "SELECT book_id, coalesce(nullif(trim(category), ''), nullif(trim(author), ''), title) AS label FROM books")
def _(s, d):
    part = lambda c: F.nullif(F.trim(c), F.lit(""))
    return V.books(s, d).select("book_id", F.coalesce(part("category"), part("author"), "title").alias("label"))


@query("p_flatten_nested", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END AS title, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN p_size::DOUBLE ELSE p_retailprice END AS rating FROM part", base=False)
def _(s, d):
    k = F.col("p_partkey")
    inner = F.struct(F.col("p_brand").alias("title"), F.when(k % 3 == 2, F.col("p_retailprice").cast("string")).alias("rating"))
    rows = V.table(s, d, "part").select("p_partkey", F.when(k % 2 == 0, F.col("p_name")).alias("title"), F.when(k % 3 == 0, "none").when(k % 3 == 1, F.concat(F.lit(" "), F.col("p_size").cast("string"))).alias("rating"), inner.alias("info"))
    return L.flatten_nested(rows, "info", ["title", "rating"], ["rating"])


# ---- joins, windows, lookups ----------------------------------------------

ROWS = "meta AS (SELECT 'src' || (p_partkey % 30) AS book_id, CASE p_partkey % 3 WHEN 0 THEN 'shelf' WHEN 1 THEN 'review' ELSE 'other' END AS source, min(p_partkey)::VARCHAR AS isbn, [min(p_type)] AS subjects, max(1700000000 + p_partkey) AS fetched_at FROM part GROUP BY 1, 2)"


def _metadata(s, d):
    k = F.col("p_partkey")
    source = F.when(k % 3 == 0, "shelf").when(k % 3 == 1, "review").otherwise("other")
    rows = V.table(s, d, "part").groupBy(F.concat(F.lit("src"), (k % 30).cast("string")).alias("book_id"), source.alias("source"))
    return rows.agg(F.min("p_partkey").cast("string").alias("isbn"), F.array(F.min("p_type")).alias("subjects"), (F.max("p_partkey") + 1700000000).alias("fetched_at"))


@query("j_left_meta", f", {ROWS} SELECT b.book_id, coalesce(m.isbn, '') AS isbn, coalesce(x.sources, '') AS sources, x.fetched_at, CASE WHEN x.fetched_at IS NULL THEN 'missing' ELSE 'ready' END AS state FROM books b LEFT JOIN meta m ON m.book_id = b.book_id AND m.source = 'shelf' LEFT JOIN (SELECT book_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, max(fetched_at) AS fetched_at FROM meta GROUP BY 1) x ON x.book_id = b.book_id WHERE NOT b.is_deleted")
def _(s, d):
    return L.with_metadata(V.books(s, d), _metadata(s, d), "shelf")


@query("s_source_priority", f"WITH {ROWS} SELECT book_id, arg_min(source, CASE source WHEN 'review' THEN 1 WHEN 'shelf' THEN 2 ELSE 3 END) AS source FROM meta GROUP BY 1", base=False)
def _(s, d):
    return L.by_priority(_metadata(s, d), "book_id", "source", ["review", "shelf"]).select("book_id", "source")


@query("j_scalar_subq", "SELECT book_id, (SELECT count(*) FROM notes n WHERE n.book_id = b.book_id) AS evidence, coalesce((SELECT max(created) FROM notes n WHERE n.book_id = b.book_id), 0) AS latest FROM books b")
def _(s, d):
    n = V.notes(s, d).groupBy("book_id").agg(F.count(F.lit(1)).alias("n"), F.max("created").alias("latest"))
    return V.books(s, d).join(n, "book_id", "left").select("book_id", F.coalesce("n", F.lit(0)).alias("evidence"), F.coalesce("latest", F.lit(0)).alias("latest"))


@query("w_relation_pick", "SELECT book_id, note_id, CAST(score AS INTEGER) AS score FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY score DESC, note_id) AS rn FROM (SELECT book_id, note_id, CASE WHEN contains(content, 'tha') OR contains(chapter, 'tha') THEN 10 ELSE 0 END + CASE WHEN contains(content, 'fr') OR contains(chapter, 'fr') THEN 10 ELSE 0 END + CASE WHEN note_type = 'thought' THEN 1 ELSE 0 END AS score FROM notes WHERE book_id IN ('src3', 'src4'))) WHERE rn <= 12")
def _(s, d):
    return G.relation_pick(V.notes(s, d), "src3", "src4", ["tha", "fr"])


@query("w_seq_position", "SELECT doc_id, source, coalesce(sum(CAST(ceil(n_chars / 1200.0) AS BIGINT)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM documents", base=False)
def _(s, d):
    rows = V.table(s, d, "documents").select("doc_id", "source", F.ceil(F.col("n_chars") / 1200).alias("chunks"))
    return J.sequence_positions(rows, "source", "doc_id", "chunks").select("doc_id", "source", "first")


@query("m_append_new_by_id", "WITH b AS (SELECT min(doc_id) AS lo, max(doc_id) - min(doc_id) AS n FROM documents) SELECT doc_id, 1 AS page FROM documents, b WHERE doc_id - lo < 0.6 * n UNION ALL SELECT doc_id, 2 FROM documents, b WHERE doc_id - lo >= 0.6 * n", base=False)
def _(s, d):
    x = V.table(s, d, "documents").select("doc_id")
    at = x.crossJoin(F.broadcast(x.agg(F.min("doc_id").alias("lo"), (F.max("doc_id") - F.min("doc_id")).alias("n"))))  # one row
    first, second = (at.where(c).select("doc_id") for c in ("doc_id - lo < 0.6 * n", "doc_id - lo > 0.4 * n"))
    return L.append_new(first.withColumn("page", F.lit(1)), second.withColumn("page", F.lit(2)), "doc_id")


@query("t_candidates_fallback", "SELECT note_id FROM notes ORDER BY note_id LIMIT 800")
def _(s, d):
    return R.hybrid_search(V.notes(s, d), V.index(s, d, "notes"), "***", 800).select("note_id")


@query("e_meta_upsert", f"WITH {ROWS}, new AS (SELECT * REPLACE (CASE WHEN isbn::BIGINT % 2 = 0 THEN isbn || 'n' END AS isbn, CASE WHEN isbn::BIGINT % 5 = 0 THEN [] ELSE ['new'] END AS subjects) FROM meta WHERE isbn::BIGINT % 7 <> 0) SELECT m.book_id, m.source, coalesce(n.isbn, m.isbn) AS isbn, CASE WHEN len(n.subjects) > 0 THEN n.subjects ELSE m.subjects END AS subjects FROM meta m LEFT JOIN new n ON n.book_id = m.book_id AND n.source = m.source", base=False, lists=("subjects",))
def _(s, d):
    m = _metadata(s, d)
    k = F.col("isbn").cast("bigint")
    new = m.where(k % 7 != 0).select("book_id", "source", F.when(k % 2 == 0, F.concat("isbn", F.lit("n"))).alias("isbn"), F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("new"))).alias("subjects"))
    return L.keep_detail(m, new, ["book_id", "source"], ["subjects"]).select("book_id", "source", "isbn", "subjects")


@query("m_recommend_merge", "SELECT p_partkey, coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_name END, 'hit ' || p_brand) AS title, CASE WHEN p_partkey % 3 = 0 THEN p_size::DOUBLE ELSE p_retailprice END AS rating FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name END, p_retailprice FROM part WHERE p_partkey % 5 = 0", base=False)
def _(s, d):
    p, k = V.table(s, d, "part"), F.col("p_partkey")
    detail = p.select("p_partkey", F.when(k % 2 == 0, F.col("p_name")).alias("title"), F.col("p_retailprice").alias("rating"))
    hit = p.where("p_partkey % 5 <> 0").select("p_partkey", F.concat(F.lit("hit "), "p_brand").alias("title"), F.when(k % 3 == 0, F.col("p_size").cast("double")).alias("rating"))
    return L.merge_recommendation(detail, hit, "p_partkey", ["rating"])


# ---- relations ------------------------------------------------------------


@query("g_versions", "WITH k AS (SELECT p_partkey AS id, regexp_replace(lower(p_name), ' ', '', 'g') AS key, (p_size % 10)::VARCHAR AS isbn FROM part), n AS (SELECT key FROM k WHERE length(key) >= 3 GROUP BY 1 HAVING count(*) BETWEEN 2 AND 12) SELECT a.id AS a, b.id AS b, 0.86::DOUBLE AS score FROM k a JOIN k b ON a.key = b.key AND a.id < b.id WHERE a.key IN (FROM n) AND a.isbn <> b.isbn", base=False)
def _(s, d):
    m = V.table(s, d, "part").select(F.col("p_partkey").alias("book_id"), "p_name", (F.col("p_size") % 10).cast("string").alias("isbn")).withColumnRenamed("p_name", "title")
    return G.version_edges(m).select("a", "b", F.col("score").cast("double").alias("score"))


WORDED = """, newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY created DESC, note_id) AS rn FROM notes) WHERE rn <= 250),
parts AS (SELECT book_id, title AS t, 1.2::DOUBLE AS w FROM books WHERE NOT is_deleted UNION ALL SELECT book_id, author, 2.5 FROM books WHERE NOT is_deleted UNION ALL SELECT book_id, category, 4.0 FROM books WHERE NOT is_deleted
  UNION ALL SELECT book_id, chapter, 1.5 FROM newest UNION ALL SELECT book_id, substring(content, 1, 800), CASE WHEN note_type = 'thought' THEN 2.2 ELSE 1.0 END FROM newest),
bt AS (SELECT book_id, term, round(sum(w), 6) AS tf FROM (SELECT book_id, w, unnest(GW(t)) AS term FROM parts) GROUP BY 1, 2),
nb AS (SELECT count(*) AS n FROM books WHERE NOT is_deleted), bdf AS (SELECT term, count(*) AS df FROM bt, nb GROUP BY term, n HAVING count(*) < 0.45 * n),
bw AS (SELECT book_id, term, weight FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY weight DESC, term) AS rn FROM (SELECT book_id, term, round((1 + ln(tf)) * ln(1 + n::DOUBLE / df), 9) AS weight FROM bt JOIN bdf USING (term), nb)) WHERE rn <= 120)
""".replace("GW(t)", GRAPH_WORDS.format("t"))


def _book_weights(s, d):
    books, notes = V.books(s, d).where(~F.col("is_deleted")), V.notes(s, d)
    return books, notes, L.settle(G.term_weights(G.book_terms(books, notes), books.count()))


@query("a_tf_weighted", WORDED + "SELECT * FROM bw")
def _(s, d):
    return _book_weights(s, d)[2]


@query("w_topk_terms", WORDED + "SELECT book_id, term, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY weight DESC, term) AS rn FROM bw) WHERE rn <= 5")
def _(s, d):
    return L.top_per_group(_book_weights(s, d)[2], "book_id", 5, F.desc("weight"), F.asc("term")).select("book_id", "term", "rank")


LEXICAL = WORDED + f""", norms AS (SELECT book_id, sqrt(sum(weight * weight)) AS norm FROM bw GROUP BY 1), post AS (SELECT term FROM bw GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50),
pp AS (SELECT a.book_id AS a, b.book_id AS b, sum(a.weight * b.weight) AS dot, list(a.term ORDER BY round(a.weight * b.weight, 9) DESC, a.term) AS terms FROM bw a JOIN bw b ON a.term = b.term AND a.book_id < b.book_id WHERE a.term IN (FROM post) GROUP BY 1, 2),
pc AS (SELECT a, b, round(dot / (x.norm * y.norm), 6) AS cosine, terms[1:16] AS shared, p.author = q.author AND p.author <> '' AS one, {key_sql(WORK.format('p.book_id', 'p.title'))} AS ka, {key_sql(WORK.format('q.book_id', 'q.title'))} AS kb FROM pp JOIN norms x ON x.book_id = a JOIN norms y ON y.book_id = b JOIN books p ON p.book_id = a JOIN books q ON q.book_id = b WHERE len(terms) >= 2),
pd AS (SELECT a, b, cosine, shared, one FROM pc WHERE cosine >= 0.02 AND NOT (least(length(ka), length(kb)) >= 3 AND (ka = kb OR (least(length(ka), length(kb)) >= 4 AND (contains(ka, kb) OR contains(kb, ka)))))),
nw AS (SELECT book_id, note_id, coalesce(chapter, '') AS chapter, list_intersect(list_distinct({GRAPH_WORDS.format("concat_ws(' ', coalesce(chapter, ''), substring(content, 1, 1200))")}), (SELECT list(term) FROM bw WHERE bw.book_id = newest.book_id)) AS words FROM newest),
hits AS (SELECT a, b, book_id, chapter, list_filter(shared, lambda w: list_contains(words, w)) AS matched FROM pd JOIN nw ON nw.book_id IN (a, b) WHERE list_has_any(shared, words)),
told AS (SELECT a, b, book_id, list_distinct(flatten(list(matched))) AS t FROM hits GROUP BY 1, 2, 3),
kw AS (SELECT pd.a, pd.b, cosine, one, list_filter(shared, lambda w: list_contains(l.t, w) AND list_contains(r.t, w))[1:5] AS keywords FROM pd JOIN told l ON l.a = pd.a AND l.b = pd.b AND l.book_id = pd.a JOIN told r ON r.a = pd.a AND r.b = pd.b AND r.book_id = pd.b),
sh AS (SELECT hits.a, hits.b, count(*) AS notes, count(DISTINCT book_id || ':' || chapter) AS chapters FROM hits JOIN kw ON kw.a = hits.a AND kw.b = hits.b WHERE len(keywords) >= 2 AND list_has_any(matched, keywords) GROUP BY 1, 2),
sc AS (SELECT a, b, cosine, one, keywords, notes, chapters, round(0.55 * cosine + 0.20 * least(1.0, len(keywords) / 5.0) + 0.15 * least(1.0, notes / 6.0) + 0.10 * least(1.0, chapters / 4.0), 6) AS score FROM kw JOIN sh USING (a, b))
"""


@query("g_lexical_score", LEXICAL + "SELECT a, b, cosine, keywords, notes, chapters, score, CASE WHEN one THEN 'same author' WHEN score >= 0.28 THEN 'much alike' WHEN score >= 0.12 THEN 'alike' ELSE 'perhaps related' END AS relation FROM sc", lists=("keywords",))
def _(s, d):
    books, notes, weights = _book_weights(s, d)
    return G.lexical_relations(_work_titles(books), notes, weights)


@query("a_pair_dot", LEXICAL + "SELECT a, b, round(dot, 6) AS dot, terms[1:16] AS shared FROM pp", lists=("shared",))
def _(s, d):
    w = _book_weights(s, d)[2]
    x = G.posting_pairs(w, "term", "book_id", 2, 50, "weight")
    order = F.struct((-F.round(F.col("weight_a") * F.col("weight_b"), 9)).alias("w"), "term")
    g = x.groupBy("a", "b").agg(F.round(F.sum(F.col("weight_a") * F.col("weight_b")), 6).alias("dot"), F.slice(F.array_sort(F.collect_list(order)), 1, 16).alias("t"))
    return g.select("a", "b", "dot", F.col("t.term").alias("shared"))


@query("g_note_matches", f"SELECT note_id, matched, len(matched) + CASE WHEN note_type = 'thought' THEN 0.2 ELSE 0.0 END::DOUBLE AS score FROM (SELECT note_id, note_type, list_filter(['the', 'and', 'fra', 'oned'], lambda k: list_contains({GRAPH_WORDS.format(chr(99) + 'oncat_ws(chr(32), coalesce(chapter, chr(32)), substring(content, 1, 1200))')}, k)) AS matched FROM notes) WHERE len(matched) > 0", lists=("matched",))
def _(s, d):
    return G.note_matches(V.notes(s, d), ["the", "and", "fra", "oned"]).select("note_id", "matched", F.col("score").cast("double").alias("score"))


EDGES = "e AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'semantic:' WHEN 1 THEN 'metadata:shelf:' ELSE '' END || o_orderkey AS id, 'src' || (o_custkey % 20) AS a, 'src' || (o_orderkey % 23) AS b, round(o_totalprice / 600000, 6) AS score, CASE WHEN o_custkey % 4 = 0 THEN 'same author' ELSE 'alike' END AS relation FROM orders)"


def _edges(s, d):
    o, k = V.table(s, d, "orders"), F.col("o_orderkey")
    kind = F.when(k % 3 == 0, "semantic:").when(k % 3 == 1, "metadata:shelf:").otherwise("")
    name = lambda c, n: F.concat(F.lit("src"), (F.col(c) % n).cast("string"))
    return o.select(F.concat(kind, k.cast("string")).alias("id"), name("o_custkey", 20).alias("a"), name("o_orderkey", 23).alias("b"), F.round(F.col("o_totalprice") / 600000, 6).alias("score"), F.when(F.col("o_custkey") % 4 == 0, "same author").otherwise("alike").alias("relation"))


@query("g_filter_view", f", {EDGES}, ok AS (SELECT book_id FROM listed WHERE highlight_count + thought_count > 0), x AS (SELECT id, a, b, score FROM e WHERE score >= 0.1 AND a IN (FROM ok) AND b IN (FROM ok)) SELECT 'ego' AS view, * FROM (SELECT * FROM x WHERE starts_with(id, 'metadata:shelf:') AND 'src3' IN (a, b) ORDER BY score DESC, id LIMIT 10) UNION ALL SELECT 'local', e.id, e.a, e.b, e.score FROM e WHERE NOT starts_with(id, 'semantic:') AND NOT starts_with(id, 'metadata:') AND contains(relation, 'author') AND score >= 0.3 AND a IN (SELECT book_id FROM listed) AND b IN (SELECT book_id FROM listed)")
def _(s, d):
    books, edges = L.book_list(V.books(s, d), V.highlights(s, d), V.thoughts(s, d)), _edges(s, d)
    ego = G.filter_view(edges, books, 0.1, "shelf", "analyzable", "src3", "balanced").select(F.lit("ego").alias("view"), "id", "a", "b", "score")
    return ego.union(G.filter_view(edges, books, 0.3, "local", "author").select(F.lit("local"), "id", "a", "b", "score"))


@query("g_pair_context", ", c AS (SELECT doc_id AS claim_id, CASE doc_id % 3 WHEN 0 THEN 'agree' WHEN 1 THEN 'differ' ELSE 'noise' END AS kind, [CASE WHEN (doc_id + i) % 3 <> 0 THEN 'h' ELSE 't' END || (doc_id + i) FOR i IN range(0, 40)] AS ev FROM documents), u AS (SELECT claim_id, kind, unnest(ev) AS note_id, unnest(range(0, 40)) AS pos FROM c WHERE kind <> 'noise'), o AS (SELECT claim_id, kind, note_id, book_id, pos FROM u JOIN notes USING (note_id) WHERE book_id IN ('src3', 'src4')) SELECT claim_id, kind, list(note_id ORDER BY pos)[1:4] AS evidence FROM o GROUP BY 1, 2 HAVING count(DISTINCT book_id) = 2 ORDER BY claim_id LIMIT 3", lists=("evidence",))
def _(s, d):
    k = F.col("doc_id")
    at = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.concat(F.when((k + i) % 3 != 0, "h").otherwise("t"), (k + i).cast("string")))
    c = V.table(s, d, "documents").select(k.alias("claim_id"), F.when(k % 3 == 0, "agree").when(k % 3 == 1, "differ").otherwise("noise").alias("kind"), at.alias("evidence"))
    return G.valid_claims(c, V.notes(s, d), "src3", "src4", ["agree", "differ"])


@query("g_embed_incremental", ", t AS (SELECT note_id, title || chr(10) || chapter || chr(10) || substring(content, 1, 1600) AS text FROM notes), h AS (SELECT note_id, text, md5('m1|' || text) AS content_hash FROM t) SELECT note_id, content_hash, CAST(length(text) AS FLOAT) AS first FROM h WHERE NOT (CAST(substring(note_id, 2) AS BIGINT) % 2 = 0 AND CAST(substring(note_id, 2) AS BIGINT) % 3 <> 0)")
def _(s, d):
    n = V.notes(s, d)
    number = F.substring("note_id", 2, 20).cast("bigint")
    nothing = s.createDataFrame([], "note_id string, content_hash string")
    now = G.to_embed(n, nothing, "m1").select("note_id", "content_hash")
    stored = now.where(number % 2 == 0).withColumn("content_hash", F.when(number % 3 == 0, F.lit("old")).otherwise(F.col("content_hash")))
    made = G.embed(G.to_embed(n, stored, "m1"), lambda texts: [[float(len(t)), 0.0] for t in texts])
    return made.select("note_id", "content_hash", F.col("vector")[0].alias("first"))


# ---- imports and jobs -----------------------------------------------------

SOURCES = "so AS (SELECT source AS source_id, max(doc_id) % 4 = 0 AS is_deleted FROM documents GROUP BY 1 UNION ALL SELECT 'none', FALSE), ch AS (SELECT source AS source_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT) AS position, text AS content, md5(text) AS hash FROM documents)"


def _library(s, d):
    doc = V.table(s, d, "documents")
    sources = doc.groupBy(F.col("source").alias("source_id")).agg((F.max("doc_id") % 4 == 0).alias("is_deleted")).union(s.createDataFrame([("none", False)], "source_id string, is_deleted boolean"))
    position = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1
    return sources, doc.select(F.col("source").alias("source_id"), position.cast("bigint").alias("position"), F.col("text").alias("content"), F.md5("text").alias("hash"))


@query("m_source_list", f"WITH {SOURCES} SELECT so.source_id, so.is_deleted, count(ch.source_id) AS chunks, coalesce(sum(length(content)), 0)::BIGINT AS chars FROM so LEFT JOIN ch USING (source_id) GROUP BY 1, 2", base=False)
def _(s, d):
    return J.source_list(*_library(s, d), deleted_too=True).select("source_id", "is_deleted", "chunks", F.col("chars").cast("bigint").alias("chars"))


@query("m_source_detail", f"WITH {SOURCES} SELECT so.source_id, is_deleted, position, hash FROM so JOIN ch USING (source_id) WHERE source_id = 'src3'", base=False)
def _(s, d):
    return J.source_detail(*_library(s, d), "src3").select("source_id", "is_deleted", "position", "hash")


@query("m_source_delete", f"WITH {SOURCES} SELECT 'soft' AS way, source_id, is_deleted OR source_id IN ('src1', 'src2') AS is_deleted, 0::BIGINT AS chunks FROM so UNION ALL SELECT 'purged', source_id, FALSE, count(*) FROM ch WHERE source_id NOT IN ('src1', 'src2') GROUP BY 2", base=False)
def _(s, d):
    sources, chunks = _library(s, d)
    ids = s.createDataFrame([("src1",), ("src2",)], "source_id string")
    soft = J.delete_sources(sources, ids).select(F.lit("soft").alias("way"), "source_id", "is_deleted", F.lit(0).cast("bigint").alias("chunks"))
    left = J.purge(chunks, ids, "source_id").groupBy("source_id").agg(F.count(F.lit(1)).alias("chunks"))
    return soft.union(left.select(F.lit("purged"), "source_id", F.lit(False), "chunks"))


@query("m_import_preview", f"WITH {SOURCES} SELECT source_id, position, substring(content, 1, 400) AS content, hash IN (SELECT md5(text) FROM documents WHERE doc_id % 10 = 0) AS duplicate FROM ch WHERE position < 5", base=False)
def _(s, d):
    known = V.table(s, d, "documents").where("doc_id % 10 = 0").select(F.md5("text").alias("hash"))
    return J.preview(_library(s, d)[1], known)


@query("e_validate_size", f"WITH {SOURCES} SELECT so.source_id, CASE WHEN count(ch.source_id) = 0 OR coalesce(sum(length(content)), 0) = 0 THEN 'empty' WHEN sum(length(content)) > 40000000 THEN 'too large' ELSE 'ok' END AS verdict FROM so LEFT JOIN ch USING (source_id) GROUP BY 1", base=False)
def _(s, d):
    rows = J.source_list(*_library(s, d), deleted_too=True)
    return rows.select("source_id", J.size_verdict(F.col("chunks"), F.col("chars")).alias("verdict"))


JOBS = "jb AS (SELECT c_custkey AS job_id, ['completed', 'cancelled', 'failed', 'parsing', 'paused', 'pending'][1 + c_custkey % 6] AS status FROM customer), stg AS (SELECT o_custkey AS job_id, CASE o_orderkey % 4 WHEN 0 THEN 'redirect' WHEN 1 THEN 'too_short' ELSE 'accepted' END AS filter_status, o_orderkey AS page_id FROM orders), iss AS (SELECT o_custkey AS job_id, o_orderkey AS issue_id, CASE o_orderkey % 7 WHEN 0 THEN 'parse_error' WHEN 1 THEN 'conflict' ELSE 'broken_redirect' END AS code FROM orders WHERE o_orderkey % 3 = 0)"


def _jobs(s, d):
    o, k = V.table(s, d, "orders"), F.col("o_orderkey")
    states = F.array(*[F.lit(x) for x in ("completed", "cancelled", "failed", "parsing", "paused", "pending")])
    jobs = V.table(s, d, "customer").select(F.col("c_custkey").alias("job_id"), F.element_at(states, (F.col("c_custkey") % 6 + 1).cast("int")).alias("status"))
    staged = o.select(F.col("o_custkey").alias("job_id"), F.when(k % 4 == 0, "redirect").when(k % 4 == 1, "too_short").otherwise("accepted").alias("filter_status"), k.alias("page_id"))
    issues = o.where(k % 3 == 0).select(F.col("o_custkey").alias("job_id"), k.alias("issue_id"), F.when(k % 7 == 0, "parse_error").when(k % 7 == 1, "conflict").otherwise("broken_redirect").alias("code"))
    return jobs, staged, issues


@query("m_job_delete", f"WITH {JOBS}, gone AS (SELECT job_id FROM jb WHERE job_id % 4 = 0 AND status IN ('completed', 'cancelled', 'failed')) SELECT job_id, status, (SELECT count(*) FROM stg WHERE stg.job_id = jb.job_id) AS staged FROM jb WHERE job_id NOT IN (FROM gone)", base=False)
def _(s, d):
    jobs, staged, _ = _jobs(s, d)
    left, rows = J.delete_jobs(jobs, staged, jobs.where("job_id % 4 = 0").select("job_id"))
    n = rows.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    return left.join(n, "job_id", "left").select("job_id", "status", F.coalesce("n", F.lit(0)).alias("staged"))


@query("e_report", f"WITH {JOBS}, h AS (SELECT job_id, bool_or(code IN ('parse_error', 'conflict')) AS bad FROM iss GROUP BY 1), a AS (SELECT job_id, count(*) FILTER (filter_status = 'accepted') AS accepted, count(*) FILTER (filter_status <> 'accepted') AS filtered FROM stg GROUP BY 1), x AS (SELECT job_id, list(issue_id ORDER BY issue_id)[1:20] AS examples FROM iss GROUP BY 1), c AS (SELECT job_id, list(code || '=' || n ORDER BY code) AS codes FROM (SELECT job_id, code, count(*) AS n FROM iss GROUP BY 1, 2) GROUP BY 1) SELECT jb.job_id, CASE WHEN status = 'completed' AND coalesce(bad, FALSE) THEN 'partial_success' WHEN status = 'completed' THEN 'success' WHEN status IN ('cancelled', 'paused', 'failed') THEN status ELSE 'in_progress' END AS conclusion, coalesce(accepted, 0) AS accepted, coalesce(filtered, 0) AS filtered, codes, examples FROM jb LEFT JOIN h USING (job_id) LEFT JOIN a USING (job_id) LEFT JOIN x USING (job_id) LEFT JOIN c USING (job_id)", base=False, lists=("codes", "examples"))
def _(s, d):
    r = J.report(*_jobs(s, d))
    return r.select("job_id", "conclusion", "accepted", "filtered", F.transform("codes", lambda c: F.concat(c["what"], F.lit("="), c["n"].cast("string"))).alias("codes"), "examples")


@query("st_checkpoint", "SELECT p_partkey AS page_id, p_partkey + 1000 AS revision_id FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 0", base=False)
def _(s, d):
    pages = V.wiki_pages(s, d).select("page_id", "revision_id")
    staged = pages.where("page_id % 3 = 0").withColumn("revision_id", F.col("revision_id") - F.when(F.col("page_id") % 2 == 0, 1).otherwise(0))  # of even pages an older revision
    return J.unstaged(pages, staged)


@query("e_stage", "WITH old AS (SELECT p_partkey AS page_id, p_partkey AS revision_id, 'old' AS summary, CASE WHEN p_partkey % 5 = 0 THEN 'published' ELSE 'pending' END AS publish_status FROM part WHERE p_partkey % 2 = 0), new AS (SELECT p_partkey AS page_id, p_partkey + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS revision_id, 'new' AS summary FROM part) SELECT page_id, CASE WHEN o.page_id IS NULL OR (publish_status = 'pending' AND n.revision_id <> o.revision_id) THEN n.revision_id ELSE o.revision_id END AS revision_id, CASE WHEN o.page_id IS NULL OR (publish_status = 'pending' AND n.revision_id <> o.revision_id) THEN 'new' ELSE 'old' END AS summary, coalesce(publish_status, 'pending') AS publish_status FROM new n LEFT JOIN old o USING (page_id)", base=False)
def _(s, d):
    p, k = V.table(s, d, "part"), F.col("p_partkey")
    old = p.where(k % 2 == 0).select(k.alias("page_id"), k.alias("revision_id"), F.lit("old").alias("summary"), F.when(k % 5 == 0, "published").otherwise("pending").alias("publish_status"))
    new = p.select(k.alias("page_id"), (k + F.when(k % 3 == 0, 1).otherwise(0)).alias("revision_id"), F.lit("new").alias("summary"))
    return J.stage(old, new)


@query("e_missing", MORE + " SELECT id, CASE WHEN source = 'encyclopedia' AND id % 3 <> 0 AND st <> 'ignored' THEN 'source_missing' WHEN source = 'encyclopedia' AND id % 3 = 0 AND st = 'source_missing' THEN 'pending' ELSE st END AS status FROM (SELECT *, CASE WHEN id % 6 = 0 THEN 'source_missing' ELSE status END AS st FROM (SELECT * REPLACE ('t' || id AS term) FROM terms))")
def _(s, d):
    t = V.terms(s, d).withColumn("term", F.concat(F.lit("t"), F.col("id").cast("string"))).withColumn("status", F.when(F.col("id") % 6 == 0, "source_missing").otherwise(F.col("status")))
    return J.mark_missing(t, t.where("id % 3 = 0").select("term"), True).select("id", "status")


@query("st_progress", "WITH e AS (SELECT user_id AS job_id, event_id, (event_id * 7) % 90 AS done, 80 AS total FROM events) SELECT job_id, event_id AS step, CAST(max(CASE WHEN done >= total THEN 100 ELSE floor(10 + 80 * least(1.0, done / total::DOUBLE)) END) OVER (PARTITION BY job_id ORDER BY event_id) AS INTEGER) AS percent FROM e", base=False)
def _(s, d):
    e = V.table(s, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("at"), (F.col("event_id") * 7 % 90).alias("done"), F.lit(80).alias("total"))
    return J.progress(e).withColumnRenamed("at", "step")


@query("st_index_maintenance", ", c AS (SELECT note_id AS id, CASE WHEN CAST(substring(note_id, 2) AS BIGINT) % 7 = 1 THEN 'changed text' ELSE content END AS content FROM notes WHERE CAST(substring(note_id, 2) AS BIGINT) % 20 <> 0) SELECT id, 'content' AS field, term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(strip_accents(lower(content)), '[\\p{L}\\p{N}]+')) AS term FROM c) GROUP BY 1, 2, 3")
def _(s, d):
    n, k = V.notes(s, d), F.substring("note_id", 2, 20).cast("bigint")
    index = SearchIndex.build(n, folders.work_folder(s), "note_id", ("content",))
    changed = n.where((k % 7 == 1) & (k % 20 != 0)).withColumn("content", F.lit("changed text"))
    gone = n.where(k % 20 == 0).select(F.col("note_id").alias("id"))
    index.update(changed, gone, "note_id", ("content",))
    return index.entries().select("id", F.lit("content").alias("field"), "term", F.col("tf").cast("bigint").alias("tf"))
