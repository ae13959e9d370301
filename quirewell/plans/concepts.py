"""Queries of concepts: answers built from events, concepts from parts, their evidence and relations from line items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import concepts as C
from ..sources import views as V
from .catalog import query

#: Relations that the answers name; the last one is unknown.
NAMED = [*C.RELATION_KINDS, "likes"]
_KINDS = "CASE e % 5 WHEN 0 THEN 'Concept ' WHEN 1 THEN 'topic' WHEN 2 THEN 'idea' WHEN 3 THEN 'person' ELSE 'concept' END"
_NAME = "CASE WHEN e % 11 = 0 THEN '  ' ELSE 'Name  ' || (e % 17) END"
_CONF = "CASE e % 7 WHEN 0 THEN NULL WHEN 1 THEN 7.5 WHEN 2 THEN -3.0 ELSE (e % 10) / 10.0 END"
_NOTE = "'d' || (answer_id % 100 + 100 * (e % 13))"

EVENTS = f"""WITH ev AS (SELECT user_id AS answer_id, event_id AS e, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events WHERE user_id % 20 <> 0),
gn AS (SELECT doc_id % 100 AS answer_id, 'd' || doc_id AS note_id, source AS book_id, substring(text, 1, 160) AS quote FROM documents),
a0 AS (SELECT ev.*, nullif(trim(regexp_replace({_NAME}, '\\s+', ' ', 'g')), '') AS name, lower(trim({_KINDS})) AS kind, greatest(0.0, least(1.0, coalesce({_CONF}, 0.5)))::DOUBLE AS confidence, {_NOTE} AS id1, e % 4 = 0 AS forged,
  'Name ' || (e % 17) AS f, 'Name ' || ((e * 7) % 19) AS t, {NAMED}[1 + e % 8] AS relation FROM ev),
a1 AS (SELECT a0.*, gn.book_id, gn.quote, gn.note_id IS NOT NULL AS given, kind IN ('concept', 'topic', 'idea') AS good FROM a0 LEFT JOIN gn ON gn.answer_id = a0.answer_id AND gn.note_id = a0.id1),
a2 AS (SELECT *, min(pos) FILTER (good AND name IS NOT NULL) OVER (PARTITION BY answer_id, name) AS first FROM a1),
je AS (SELECT *, CASE WHEN name IS NULL THEN 'blank_name' WHEN NOT good THEN 'bad_kind' WHEN pos > first THEN 'repeated' WHEN given THEN 'accepted' ELSE 'without_evidence' END AS verdict FROM a2),
own AS (SELECT DISTINCT answer_id, name FROM je WHERE name IS NOT NULL AND good),
jr AS (SELECT x.*, CASE WHEN relation = 'likes' THEN 'bad_kind' WHEN f = t THEN 'self' WHEN ((x.answer_id, f) NOT IN (SELECT (answer_id, name) FROM own) AND f <> 'Name 18') OR ((x.answer_id, t) NOT IN (SELECT (answer_id, name) FROM own) AND t <> 'Name 18') THEN 'unknown_endpoint' WHEN given THEN 'accepted' ELSE 'unknown_note' END AS rverdict FROM a1 x)
"""


def _answers(s, d):
    """Answers as a model words them: some text, fenced JSON, or none at all."""
    e = V.table(s, d, "events").select(F.col("user_id").alias("answer_id"), F.col("event_id").alias("e"))
    sql = lambda x: F.expr(x)
    ids = F.concat(F.array(sql(_NOTE)), F.when(F.col("e") % 4 == 0, F.array(F.concat(F.lit("forged"), F.col("e")))).otherwise(F.array(F.lit(" "))))
    entity = F.struct(sql(_KINDS).alias("kind"), sql(_NAME).alias("canonical_name"), F.lit("about").alias("description"), F.array(F.concat(F.lit("Alias "), (F.col("e") % 3).cast("string")), sql(_NAME), F.lit(" ")).alias("aliases"), sql(_CONF).cast("double").alias("confidence"), ids.alias("evidence_note_ids"))
    named = F.element_at(F.array(*map(F.lit, NAMED)), (F.col("e") % 8 + 1).cast("int"))
    relation = F.struct(F.concat(F.lit(" Name "), (F.col("e") % 17).cast("string")).alias("from"), F.concat(F.lit("Name   "), (F.col("e") * 7 % 19).cast("string")).alias("to"), named.alias("relation"), F.lit("since").alias("summary"), sql(_CONF).cast("double").alias("confidence"), ids.alias("evidence_note_ids"))
    packed = e.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("e", entity.alias("x"), relation.alias("r")))).alias("items"))
    body = F.to_json(F.struct(F.col("items.x").alias("entities"), F.col("items.r").alias("relations")))
    text = F.when(F.col("answer_id") % 20 == 0, F.lit("I found {nothing")).otherwise(F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone.")))
    doc = V.table(s, d, "documents")
    notes = doc.select((F.col("doc_id") % 100).alias("answer_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("note_id"), F.col("source").alias("book_id"), F.col("text").alias("content"))
    return packed.select("answer_id", text.alias("text")), notes


def _judged(s, d):
    answers, notes = _answers(s, d)
    parsed = C.parse_answers(answers)
    entities = C.settle(C.judge_entities(parsed, notes))
    return entities, C.settle(C.judge_relations(parsed, entities, notes, s.createDataFrame([("Name 18",)], "name string")))


@query("k_validate", EVENTS + """SELECT 'entity' AS item, answer_id, pos, kind, coalesce(name, '') AS name, '' AS other, verdict, CASE WHEN verdict IN ('accepted', 'without_evidence') THEN given::INTEGER ELSE 0 END AS evidence, CASE WHEN verdict IN ('accepted', 'without_evidence') THEN (NOT given)::INTEGER + forged::INTEGER ELSE 0 END AS unknown,
 CASE WHEN verdict = 'accepted' THEN md5(book_id || quote) END AS quoted, CASE WHEN verdict = 'accepted' THEN confidence END AS confidence, CASE WHEN name IS NULL THEN NULL ELSE 'Alias ' || (e % 3) END AS aliases FROM je
UNION ALL SELECT 'relation', answer_id, pos, relation, f, t, rverdict, CASE WHEN rverdict IN ('accepted', 'unknown_note') THEN given::INTEGER ELSE 0 END, 0, CASE WHEN rverdict = 'accepted' THEN md5(book_id || quote) END, CASE WHEN rverdict = 'accepted' THEN confidence END, NULL FROM jr""", base=False)
def _(s, d):
    entities, relations = _judged(s, d)
    first = F.get("evidence", 0)
    shared = [F.size(F.coalesce("evidence", F.array())).alias("evidence")]
    quoted = F.md5(F.concat(first["book_id"], first["quote"])).alias("quoted")
    e = entities.select(F.lit("entity").alias("item"), "answer_id", F.col("at").alias("pos"), "kind", F.coalesce("name", F.lit("")).alias("name"), F.lit("").alias("other"), "verdict", *shared, F.col("unknown").cast("int").alias("unknown"), quoted, first["confidence"].alias("confidence"), F.nullif(F.array_join("aliases", "|"), F.lit("")).alias("aliases"))
    # names that are blank have no aliases to compare
    e = e.withColumn("aliases", F.when(F.col("name") != "", F.col("aliases")))
    r = relations.select(F.lit("relation"), "answer_id", "at", "relation", "from", "to", "verdict", *shared, F.lit(0), quoted, first["confidence"], F.lit(None).cast("string"))
    return e.union(r)


@query("k_rejected", EVENTS + """SELECT answer_id, count(*) FILTER (v = 'without_evidence') AS without_evidence, sum(u)::BIGINT AS unknown_note, count(*) FILTER (v = 'unknown_endpoint') AS unknown_endpoint, count(*) FILTER (v = 'bad_kind') AS bad_kind
FROM (SELECT answer_id, verdict AS v, CASE WHEN verdict IN ('accepted', 'without_evidence') THEN (NOT given)::INTEGER + forged::INTEGER ELSE 0 END AS u FROM je UNION ALL SELECT answer_id, rverdict, (rverdict = 'unknown_note')::INTEGER FROM jr) GROUP BY 1""", base=False)
def _(s, d):
    return C.rejected(*_judged(s, d))


PERSIST = EVENTS + """, se AS (SELECT 'concept:old' || (x % 3) AS id, 'Name ' || (x % 3) AS name FROM (SELECT DISTINCT event_id % 3 AS x FROM events)),
sk AS (SELECT lower(name) AS key, id FROM se UNION ALL SELECT 'name 5', 'concept:old1'),
ok AS (SELECT *, lower(name) AS key FROM je WHERE verdict = 'accepted'),
nw AS (SELECT key, kind || ':' || md5(key || '|' || kind) AS id, kind, name FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY answer_id, pos) AS rn FROM ok) WHERE rn = 1 AND key NOT IN (SELECT key FROM sk)),
ids AS (SELECT key, id FROM sk UNION ALL SELECT key, id FROM nw),
te AS (SELECT id AS entity_id, id1 AS note_id, book_id, quote, confidence FROM (SELECT ids.id, id1, book_id, quote, confidence, row_number() OVER (PARTITION BY ids.id, id1 ORDER BY answer_id DESC, pos DESC) AS rn FROM ok JOIN ids USING (key)) WHERE rn = 1),
lk AS (SELECT 'rel:' || md5(least(a.id, b.id) || '|' || greatest(a.id, b.id) || '|' || relation) AS id, a.id AS a, b.id AS b, relation, confidence, answer_id, pos FROM jr JOIN ids a ON a.key = lower(f) JOIN ids b ON b.key = lower(t) WHERE rverdict = 'accepted' AND a.id <> b.id),
tr AS (SELECT id, arg_min(a, (answer_id, pos)) AS a, arg_min(b, (answer_id, pos)) AS b, any_value(relation) AS relation, arg_max(confidence, (answer_id, pos)) AS confidence FROM lk GROUP BY id)
"""


@query("k_persist", PERSIST + """SELECT 'entity' AS part, id, '' AS other, 'concept' AS kind, name AS text, NULL::DOUBLE AS confidence FROM se UNION ALL SELECT 'entity', id, '', kind, name, NULL FROM nw
UNION ALL SELECT 'evidence', entity_id, note_id, '', md5(book_id || quote), confidence FROM te UNION ALL SELECT 'evidence', 'concept:old0', 'kept', '', md5('bq'), 0.25
UNION ALL SELECT 'relation', id, '', relation, a || '>' || b, confidence FROM tr UNION ALL SELECT 'relation', 'rel:kept', '', 'related', 'concept:old0>concept:old1', 0.5
UNION ALL SELECT 'state', 'd' || doc_id, '', '', md5(text), NULL FROM documents UNION ALL SELECT 'state', 'gone', '', '', 'h', NULL""", base=False)
def _(s, d):
    entities, relations = _judged(s, d)
    _, notes = _answers(s, d)
    stored = V.table(s, d, "events").select((F.col("event_id") % 3).alias("x")).distinct().select(F.concat(F.lit("concept:old"), F.col("x").cast("string")).alias("id"), F.lit("concept").alias("kind"), F.concat(F.lit("Name "), F.col("x").cast("string")).alias("name"), F.lit("").alias("description"), F.when(F.col("x") == 1, F.array(F.lit("NAME 5"))).otherwise(F.array().cast("array<string>")).alias("aliases"), F.lit("confirmed").alias("status"))
    evidence = s.createDataFrame([("concept:old0", "kept", "b", "q", 0.25)], "entity_id string, note_id string, book_id string, quote string, confidence double")
    links = s.createDataFrame([("rel:kept", "concept:old0", "concept:old1", "related", "", 0.5)], "id string, a string, b string, relation string, summary string, confidence double")
    states = s.createDataFrame([("gone", "h"), ("d1", "older")], "note_id string, content_hash string")
    e, v, r, n = C.persist(stored, evidence, links, states, C.accepted(entities), C.accepted(relations), notes)
    none, blank = F.lit(None).cast("double").alias("confidence"), F.lit("")
    parts = [
        e.select(F.lit("entity").alias("part"), "id", blank.alias("other"), "kind", F.col("name").alias("text"), none), v.select(F.lit("evidence"), "entity_id", "note_id", blank, F.md5(F.concat("book_id", "quote")), "confidence"),
        r.select(F.lit("relation"), "id", blank, "relation", F.concat("a", F.lit(">"), "b"), "confidence"), n.select(F.lit("state"), "note_id", blank, blank, "content_hash", none),
    ]
    return reduce(DataFrame.union, parts)


@query("k_unchanged", "SELECT note_id FROM notes WHERE CAST(substring(note_id, 2) AS BIGINT) % 2 = 0")
def _(s, d):
    n = V.notes(s, d)
    even = F.substring("note_id", 2, 20).cast("bigint") % 2 == 0
    states = n.select("note_id", F.when(even, F.md5("content")).otherwise("old").alias("content_hash"))
    return C.unchanged(n, states)


@query("k_candidates", """WITH g AS (SELECT split_part(text, ' ', 1) AS term, CASE WHEN item_id % 3 = 0 THEN '' ELSE split_part(text, ' ', 2) END AS canonical_name, [split_part(text, ' ', 3), 'alias' || item_id] AS aliases FROM benchmark),
gx AS (SELECT coalesce(nullif(trim(canonical_name), ''), trim(term)) AS canonical, unnest([term, canonical_name] || aliases) AS alias FROM g),
n AS (SELECT regexp_replace(lower('历史，' || substring(text, 1, 3) || '的 ' || CASE WHEN doc_id % 2 = 0 THEN '历 史' ELSE '' END || text), '[^\\p{L}\\p{N}]', '', 'g') AS x FROM documents),
w AS (SELECT unnest(list_transform(range(1, length(x)), lambda i: substring(x, i, 2))) AS term FROM n)
SELECT 'glossary' AS part, lower(trim(alias)) AS term, min(canonical) AS canonical, 0::BIGINT AS n FROM gx WHERE trim(alias) <> '' GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'frequent', term, '', count(*) AS n FROM w WHERE regexp_matches(term, '[\\x{4e00}-\\x{9fff}]') GROUP BY term HAVING count(*) >= 2 ORDER BY n DESC, term LIMIT 60)""", base=False)
def _(s, d):
    doc = V.table(s, d, "documents")
    notes = doc.select(F.concat(F.lit("历史，"), F.substring("text", 1, 3), F.lit("的 "), F.when(F.col("doc_id") % 2 == 0, "历 史").otherwise(""), "text").alias("content"))
    glossary, frequent = C.candidates(notes, V.terms(s, d))
    return glossary.select(F.lit("glossary").alias("part"), F.col("alias").alias("term"), "canonical", F.lit(0).cast("bigint").alias("n")).union(frequent.select(F.lit("frequent"), "term", F.lit(""), "n"))


# ---- corrections and the graph --------------------------------------------

CONCEPTS = f"""WITH RECURSIVE en AS (SELECT 'concept:' || p_partkey AS id, p_partkey AS k, {C.ENTITY_KINDS}[1 + p_partkey % 3] AS kind, p_name || ' ' || p_partkey AS name, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_type END AS description, [p_brand] AS aliases,
  CASE p_partkey % 7 WHEN 0 THEN 'hidden' WHEN 1 THEN 'suggested' WHEN 2 THEN 'suggested' ELSE 'confirmed' END AS status, p_size AS updated_at FROM part),
vi AS (SELECT 'concept:' || l_partkey AS entity_id, 'o' || l_orderkey AS note_id, 'b' || min(l_suppkey % 10) AS book_id, min(l_returnflag) AS quote, max(l_discount * 10) AS confidence FROM lineitem GROUP BY l_partkey, l_orderkey),
re AS (SELECT 'r' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, 'concept:' || l_partkey AS a, 'concept:' || (1 + (l_partkey * 7 + l_linenumber) % (SELECT count(*) FROM part)) AS b, {C.RELATION_KINDS}[1 + l_linenumber % 7] AS relation, l_discount * 10 AS confidence FROM lineitem)
"""


def _concepts(s, d):
    p, k = V.table(s, d, "part"), F.col("p_partkey")
    n = p.count()
    name = lambda c: F.concat(F.lit("concept:"), c.cast("string"))
    of = lambda kinds, i: F.element_at(F.array(*map(F.lit, kinds)), (i + 1).cast("int"))
    e = p.select(name(k).alias("id"), of(C.ENTITY_KINDS, k % 3).alias("kind"), F.concat("p_name", F.lit(" "), k.cast("string")).alias("name"), F.when(k % 4 == 0, "").otherwise(F.col("p_type")).alias("description"), F.array("p_brand").alias("aliases"), F.when(k % 7 == 0, "hidden").when((k % 7).isin(1, 2), "suggested").otherwise("confirmed").alias("status"), F.col("p_size").alias("updated_at"))
    item = V.table(s, d, "lineitem")
    v = item.groupBy("l_partkey", "l_orderkey").agg(F.min(F.col("l_suppkey") % 10).alias("b"), F.min("l_returnflag").alias("quote"), F.max(F.col("l_discount") * 10).alias("confidence"))
    v = v.select(name(F.col("l_partkey")).alias("entity_id"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("note_id"), F.concat(F.lit("b"), F.col("b").cast("string")).alias("book_id"), "quote", "confidence")
    r = item.select(F.concat(F.lit("r"), F.concat_ws("-", *[F.col(f"l_{c}").cast("string") for c in ("orderkey", "linenumber", "partkey", "suppkey")])).alias("id"), name(F.col("l_partkey")).alias("a"), name(1 + (F.col("l_partkey") * 7 + F.col("l_linenumber")) % n).alias("b"), of(C.RELATION_KINDS, F.col("l_linenumber") % 7).alias("relation"), (F.col("l_discount") * 10).alias("confidence"))
    return e, v, r


VIEWS = """, vis AS (SELECT * FROM en WHERE status <> 'hidden'), big AS (SELECT count(*) > 500 AS t, count(*) AS n FROM vis),
cn AS (SELECT entity_id AS id, count(*) AS evidence_count FROM vi GROUP BY 1),
g1 AS (SELECT * FROM vis WHERE id IN (SELECT entity_id FROM vi, big WHERE confidence >= CASE WHEN t THEN 0.45 ELSE 0.1 END) ORDER BY updated_at DESC, id LIMIT 600),
g2 AS (SELECT * FROM en WHERE kind IN ('topic', 'idea') AND id IN (SELECT entity_id FROM vi WHERE book_id = 'b3') AND id IN (SELECT entity_id FROM vi WHERE confidence >= 0.8) ORDER BY updated_at DESC, id LIMIT 50),
g3 AS (SELECT * FROM en WHERE id = 'concept:5' OR id IN (SELECT a FROM re WHERE b = 'concept:5' UNION SELECT b FROM re WHERE a = 'concept:5') ORDER BY description, id LIMIT 600),
gn AS (SELECT 'all' AS view, id, (SELECT n FROM big) AS total, (SELECT t FROM big) AS truncated FROM g1 UNION ALL SELECT 'kinds', id, (SELECT count(*) FROM en), (SELECT count(*) > 1000000 FROM en) FROM g2 UNION ALL SELECT 'centre', id, (SELECT count(*) FROM g3), FALSE FROM g3 WHERE status <> 'hidden')
"""


def _graph_views(s, d):
    e, v, r = (C.settle(x) for x in _concepts(s, d))
    return {"all": C.concept_graph(e, v, r, least=0.1), "kinds": C.concept_graph(e, v, r, ["topic", "idea"], "b3", 0.8, 50, hidden=True, many=1_000_000), "centre": C.concept_graph(e, v, r, centre="concept:5", least=0.3)}


@query("k_graph_query", CONCEPTS + VIEWS + "SELECT view, gn.id, kind, name, status, updated_at, coalesce(evidence_count, 0) AS evidence_count, total, truncated FROM gn JOIN en USING (id) LEFT JOIN cn USING (id)", base=False)
def _(s, d):
    return reduce(DataFrame.unionByName, [nodes.select(F.lit(view).alias("view"), "*") for view, (nodes, _) in _graph_views(s, d).items()])


@query("k_relations_between", CONCEPTS + VIEWS + """SELECT 'all' AS view, re.* FROM re, big WHERE confidence >= CASE WHEN t THEN 0.45 ELSE 0.1 END AND a IN (SELECT id FROM g1) AND b IN (SELECT id FROM g1)
UNION ALL SELECT 'kinds', * FROM re WHERE confidence >= 0.8 AND a IN (SELECT id FROM g2) AND b IN (SELECT id FROM g2)
UNION ALL SELECT 'centre', * FROM re WHERE confidence >= 0.3 AND a IN (SELECT id FROM g3 WHERE status <> 'hidden') AND b IN (SELECT id FROM g3 WHERE status <> 'hidden')""", base=False)
def _(s, d):
    return reduce(DataFrame.unionByName, [relations.select(F.lit(view).alias("view"), "*") for view, (_, relations) in _graph_views(s, d).items()])


MERGE = CONCEPTS + """, rq AS (SELECT 'concept:' || k AS source, 'concept:' || (k + 1) AS target FROM en WHERE k % 10 IN (3, 4, 5) AND k + 1 <= (SELECT max(k) FROM en)),
cl AS (SELECT source, target, 1 AS n FROM rq UNION ALL SELECT cl.source, rq.target, n + 1 FROM cl JOIN rq ON rq.source = cl.target),
tg AS (SELECT source, arg_max(target, n) AS target FROM cl GROUP BY 1),
mv AS (SELECT coalesce(target, entity_id) AS entity_id, note_id, book_id, quote, confidence, target IS NOT NULL AS came, coalesce(source, '') AS src FROM vi LEFT JOIN tg ON source = entity_id),
me AS (SELECT entity_id, note_id, arg_min(book_id, (came, src)) AS book_id, arg_max(quote, (came, src)) AS quote, max(confidence) AS confidence FROM mv GROUP BY 1, 2),
mr AS (SELECT id, coalesce(x.target, a) AS a, coalesce(y.target, b) AS b, relation, confidence FROM re LEFT JOIN tg x ON x.source = a LEFT JOIN tg y ON y.source = b),
mk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY least(a, b), greatest(a, b), relation ORDER BY id) AS rn FROM mr WHERE a <> b) WHERE rn = 1),
al AS (SELECT target, source, u.i, u.alias FROM tg JOIN en ON en.id = source, unnest(list_zip(range(0, 2), [name] || aliases)) AS z(s), (SELECT s[1] AS i, s[2] AS alias) u),
af AS (SELECT target, alias, min((source, i)) AS o FROM al JOIN en t ON t.id = target WHERE alias <> t.name AND NOT list_contains(t.aliases, alias) GROUP BY 1, 2),
ax AS (SELECT target, list(alias ORDER BY o) AS more FROM af GROUP BY 1),
dx AS (SELECT target, arg_max(description, source) AS text FROM tg JOIN en ON en.id = source WHERE description <> '' GROUP BY 1),
mo AS (SELECT id, kind, name, coalesce(text, description) AS description, aliases || coalesce(more, []) AS aliases FROM en LEFT JOIN ax ON ax.target = id LEFT JOIN dx ON dx.target = id WHERE id NOT IN (SELECT source FROM tg))
"""


@query("k_merge", MERGE + """SELECT 'entity' AS part, id, '' AS other, name AS kind, description || '#' || array_to_string(aliases, '|') AS text, NULL::DOUBLE AS confidence FROM mo
UNION ALL SELECT 'evidence', entity_id, note_id, book_id, quote, confidence FROM me UNION ALL SELECT 'relation', id, a, relation, b, confidence FROM mk""", base=False)
def _(s, d):
    e, v, r = _concepts(s, d)
    k = F.substring("id", 9, 20).cast("bigint")
    ends = e.select(k.alias("k"))
    last = ends.agg(F.max("k").alias("k")).first()["k"]
    name = lambda c: F.concat(F.lit("concept:"), c.cast("string"))
    requests = ends.where((F.col("k") % 10).isin(3, 4, 5) & (F.col("k") < last)).select(name(F.col("k")).alias("source"), name(F.col("k") + 1).alias("target"))
    e, v, r = C.merge(e, v, r, requests)
    blank = F.lit("")
    parts = [e.select(F.lit("entity").alias("part"), "id", blank.alias("other"), F.col("name").alias("kind"), F.concat("description", F.lit("#"), F.array_join("aliases", "|")).alias("text"), F.lit(None).cast("double").alias("confidence")), v.select(F.lit("evidence"), "entity_id", "note_id", "book_id", "quote", "confidence"), r.select(F.lit("relation"), "id", "a", "relation", "b", "confidence")]
    return reduce(DataFrame.union, parts)


@query("k_correct", CONCEPTS + """SELECT id, CASE WHEN k % 3 = 0 THEN 'New ' || k ELSE name END AS name, CASE WHEN k % 5 = 0 THEN 'told' ELSE description END AS description, CASE WHEN k % 2 = 0 THEN 'confirmed' ELSE status END AS status,
 CASE WHEN k % 3 = 0 THEN aliases || ['my alias'] ELSE aliases END AS aliases FROM en""", base=False, lists=("aliases",))
def _(s, d):
    e, _, _ = _concepts(s, d)
    k = F.substring("id", 9, 20).cast("bigint")
    none = F.lit(None).cast("string")
    edits = e.select("id", F.when(k % 3 == 0, F.concat(F.lit(" New   "), k.cast("string"))).alias("name"), F.when(k % 5 == 0, "told").otherwise(none).alias("description"), F.when(k % 2 == 0, "confirmed").otherwise(none).alias("status"),
                     F.when(k % 3 == 0, F.array(F.lit(" my  alias "), F.concat(F.lit("New "), k.cast("string")), F.get("aliases", 0), F.lit("my alias"))).alias("aliases"))
    return C.correct(e, edits).select("id", "name", "description", "status", "aliases")


@query("k_clear", CONCEPTS + """SELECT 'entity' AS part, id FROM en WHERE status <> 'suggested' UNION ALL SELECT 'evidence', entity_id || note_id FROM vi WHERE entity_id NOT IN (SELECT id FROM en WHERE status = 'suggested')
UNION ALL SELECT 'relation', id FROM re WHERE a NOT IN (SELECT id FROM en WHERE status = 'suggested') AND b NOT IN (SELECT id FROM en WHERE status = 'suggested')""", base=False)
def _(s, d):
    e, v, r = C.clear_suggested(*_concepts(s, d))
    return e.select(F.lit("entity").alias("part"), "id").union(v.select(F.lit("evidence"), F.concat("entity_id", "note_id"))).union(r.select(F.lit("relation"), "id"))
