"""Concepts: candidates, extraction answers and their validation, persistence, corrections, merging, the graph shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import char_pairs, normalize_name, normalize_search
from .library import settle

#: Kinds of concepts and of relations, states of a concept.
ENTITY_KINDS = ["concept", "topic", "idea"]
RELATION_KINDS = ["broader", "narrower", "related", "supports", "conflicts", "causes", "applies"]
STATUSES = ["suggested", "confirmed", "hidden"]
#: Characters of a name and of a quote; descriptions and summaries have twice a quote's.
NAME_CHARS, QUOTE_CHARS = 40, 160
#: Entities beyond which only sure ones are shown, the confidence of these, entities shown if no number is asked for, and at most.
MANY, SURE, SHOWN, MOST_SHOWN = 500, 0.45, 600, 2000


def candidates(notes: DataFrame, glossary: DataFrame, top: int = 60, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """What an extraction is told: ``alias, canonical`` of the glossary and ``term, n``, the notes' frequent pairs of characters.

    Pairs run over letters and digits in lower case, all else taken out first;
    one of the two is a Han character. Of glossary rows (``term,
    canonical_name, aliases``) the term, its canonical name and its aliases all
    lead to the canonical name, or to the term if there is none.
    """
    pairs = notes.select(F.explode(char_pairs(normalize_search(F.col("content")))).alias("term")).where(F.col("term").rlike("[\\u4e00-\\u9fff]"))
    frequent = pairs.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "term").limit(top)
    canonical = F.coalesce(F.nullif(F.trim("canonical_name"), F.lit("")), F.trim("term"))
    names = F.concat(F.array("term", "canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    each = glossary.select(canonical.alias("canonical"), F.explode(names).alias("alias")).select(F.lower(F.trim("alias")).alias("alias"), "canonical")
    return each.where("alias <> ''").groupBy("alias").agg(F.min("canonical").alias("canonical")), frequent


# ---- answers --------------------------------------------------------------


def parse_answers(answers: DataFrame) -> DataFrame:
    """``answer_id, entities, relations, readable`` of ``answer_id, text``: the JSON between the first { and the last }.

    Words or fences around it don't matter. Fields of another type than
    expected are null; an answer without readable JSON has no items. Answers are
    parsed once and kept: entities and relations are judged apart.
    """
    first = F.instr("text", "{")
    inside = F.char_length("text") - F.char_length(F.substring_index("text", "}", -1)) - first + 1  # up to the last }
    body = F.when((first > 0) & (F.instr("text", "}") > 0), F.substring(F.col("text"), first, inside))
    v = F.try_parse_json(body)
    rows = answers.select("answer_id", v.alias("v"))
    items = lambda name: F.coalesce(F.try_variant_get("v", f"$.{name}", "array<variant>"), F.array().cast("array<variant>")).alias(name)
    return settle(rows.select("answer_id", items("entities"), items("relations"), F.col("v").isNotNull().alias("readable")))


def _text(name: str) -> Column:
    return F.try_variant_get("x", f"$.{name}", "string")


def _list(name: str) -> Column:
    return F.coalesce(F.try_variant_get("x", f"$.{name}", "array<string>"), F.array().cast("array<string>"))


def _name(c: Column) -> Column:
    """A name on one line, cut; null if there is nothing."""
    return F.nullif(F.trim(normalize_name(c, NAME_CHARS)), F.lit(""))


def _sure(c: Column) -> Column:
    x = F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.5))))


def _with_evidence(items: DataFrame, notes: DataFrame) -> DataFrame:
    """``evidence`` (those of the named notes that the answer was given, in order) and ``unknown``, how many were not, for ``answer_id, at, ids``."""
    named = items.select("answer_id", "at", "confidence", F.posexplode("ids").alias("i", "id")).withColumn("note_id", F.trim("id")).where("note_id <> ''")
    given = notes.select("answer_id", "note_id", "book_id", F.substring("content", 1, QUOTE_CHARS).alias("quote"), F.lit(True).alias("given"))
    found = named.join(given, ["answer_id", "note_id"], "left")
    one = F.when(F.col("given"), F.struct("i", "note_id", "book_id", "quote", "confidence"))
    per = found.groupBy("answer_id", "at").agg(F.array_sort(F.collect_list(one)).alias("e"), F.count_if(F.col("given").isNull()).alias("unknown"))
    fields = F.transform("e", lambda x: F.struct(x["note_id"].alias("note_id"), x["book_id"].alias("book_id"), x["quote"].alias("quote"), x["confidence"].alias("confidence")))
    out = items.drop("ids").join(per.select("answer_id", "at", fields.alias("evidence"), "unknown"), ["answer_id", "at"], "left")
    return out.withColumn("unknown", F.coalesce("unknown", F.lit(0)))


def judge_entities(answers: DataFrame, notes: DataFrame) -> DataFrame:
    """Every entity of the parsed answers with its ``verdict``: blank_name, bad_kind, repeated, without_evidence or accepted.

    ``notes`` (``answer_id, note_id, book_id, content``) are those that each
    answer was given: other notes are no evidence, and ``unknown`` counts them.
    Of one name in an answer the first of a known kind stands.
    """
    x = answers.select("answer_id", F.posexplode("entities").alias("at", "x"))
    x = x.select("answer_id", "at", _name(F.coalesce(_text("canonical_name"), _text("name"))).alias("name"), F.lower(F.trim(F.coalesce(_text("kind"), F.lit("")))).alias("kind"), F.substring(F.coalesce(_text("description"), F.lit("")), 1, 2 * QUOTE_CHARS).alias("description"), _list("aliases").alias("aliases"), _sure(F.try_variant_get("x", "$.confidence", "double")).alias("confidence"), _list("evidence_note_ids").alias("ids"))
    sound = F.col("name").isNotNull() & F.col("kind").isin(ENTITY_KINDS)
    first = F.min(F.when(sound, F.col("at"))).over(Window.partitionBy("answer_id", "name"))
    x = x.withColumn("verdict", F.when(F.col("name").isNull(), "blank_name").when(~F.col("kind").isin(ENTITY_KINDS), "bad_kind").when(F.col("at") > first, "repeated"))
    x = _with_evidence(settle(x.withColumn("ids", F.when(F.col("verdict").isNull(), F.col("ids")).otherwise(F.array().cast("array<string>")))), notes)
    verdict = F.coalesce("verdict", F.when(F.size("evidence") > 0, "accepted").otherwise("without_evidence"))
    named = F.filter(F.transform("aliases", lambda a: F.nullif(F.trim(F.substring(F.trim(F.regexp_replace(a, r"\s+", " ")), 1, NAME_CHARS)), F.lit(""))), lambda a: a.isNotNull() & (a != F.col("name")))
    once = F.filter(named, lambda a, i: (i == 0) | (a != F.get(named, i - 1)))  # repeated ones side by side
    return x.select("answer_id", "at", "kind", "name", "description", once.alias("aliases"), "evidence", "unknown", verdict.alias("verdict"))


def judge_relations(answers: DataFrame, entities: DataFrame, notes: DataFrame, known: DataFrame) -> DataFrame:
    """Every relation with its ``verdict``: blank_name, bad_kind, self, unknown_endpoint, unknown_note or accepted.

    Both ends must be entities of the same answer (judged, of a known kind; with
    evidence or not) or names in ``known`` (``name``); some named note must be real.
    """
    x = answers.select("answer_id", F.posexplode("relations").alias("at", "x"))
    x = x.select("answer_id", "at", _name(_text("from")).alias("from"), _name(_text("to")).alias("to"), F.lower(F.trim(F.coalesce(_text("relation"), F.lit("")))).alias("relation"), F.substring(F.coalesce(_text("summary"), F.lit("")), 1, 2 * QUOTE_CHARS).alias("summary"), _sure(F.try_variant_get("x", "$.confidence", "double")).alias("confidence"), _list("evidence_note_ids").alias("ids"))
    own = entities.where(~F.col("verdict").isin("blank_name", "bad_kind")).select("answer_id", "name").distinct()
    known = known.select("name").distinct()
    for end in ("from", "to"):
        x = x.join(own.select("answer_id", F.col("name").alias(end), F.lit(True).alias(f"{end}_own")), ["answer_id", end], "left")
        x = x.join(known.select(F.col("name").alias(end), F.lit(True).alias(f"{end}_known")), end, "left")
    there = lambda end: F.coalesce(f"{end}_own", f"{end}_known", F.lit(False))
    verdict = F.when(F.col("from").isNull() | F.col("to").isNull(), "blank_name").when(~F.col("relation").isin(RELATION_KINDS), "bad_kind").when(F.col("from") == F.col("to"), "self").when(~there("from") | ~there("to"), "unknown_endpoint")
    x = x.withColumn("verdict", verdict).drop("from_own", "from_known", "to_own", "to_known")
    x = settle(x.withColumn("ids", F.when(F.col("verdict").isNull(), F.col("ids")).otherwise(F.array().cast("array<string>"))))
    x = _with_evidence(x, notes)
    verdict = F.coalesce("verdict", F.when(F.size("evidence") > 0, "accepted").otherwise("unknown_note"))
    return x.select("answer_id", "at", "from", "to", "relation", "summary", "confidence", "evidence", verdict.alias("verdict"))


def rejected(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """``answer_id, without_evidence, unknown_note, unknown_endpoint, bad_kind``: why items of an answer were left out."""
    both = entities.select("answer_id", "verdict", F.col("unknown").alias("notes")).union(relations.select("answer_id", "verdict", (F.col("verdict") == "unknown_note").cast("bigint")))
    count = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    return both.groupBy("answer_id").agg(count("without_evidence"), F.sum("notes").alias("unknown_note"), count("unknown_endpoint"), count("bad_kind"))


def accepted(judged: DataFrame, seen: Observation | None = None) -> DataFrame:
    """What passed; ``seen`` counts each verdict in the same pass over the rows."""
    if seen is not None:
        kinds = ("accepted", "blank_name", "bad_kind", "repeated", "self", "without_evidence", "unknown_endpoint", "unknown_note")
        judged = judged.observe(seen, *[F.count_if(F.col("verdict") == v).alias(v) for v in kinds])
    return judged.where("verdict = 'accepted'").drop("verdict", "unknown")


# ---- persistence ----------------------------------------------------------


def entity_id(kind: Column, name: Column) -> Column:
    return F.concat(kind, F.lit(":"), F.md5(F.concat(F.lower(F.trim(name)), F.lit("|"), kind)))


def relation_id(a: Column, b: Column, relation: Column) -> Column:
    return F.concat(F.lit("rel:"), F.md5(F.concat_ws("|", F.least(a, b), F.greatest(a, b), relation)))


def _keys(entities: DataFrame) -> DataFrame:
    """``key, id``: every name and alias in lower case, to the smallest id that has it."""
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return entities.select("id", F.explode(names).alias("k")).select("id", F.lower(F.trim("k")).alias("key")).where("key <> ''").groupBy("key").agg(F.min("id").alias("id"))


def persist(entities: DataFrame, evidence: DataFrame, relations: DataFrame, states: DataFrame, found: DataFrame, links: DataFrame, scanned: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four tables after an extraction.

    Stored ``entities`` (``id, kind, name, description, aliases, status``) stay as they are; accepted ones (``found``)
    whose name no stored one has, as name or alias of either case, come as suggested, the first answer's for each name.
    ``evidence`` (``entity_id, note_id, book_id, quote, confidence``) and ``relations`` (``id, a, b, relation, summary,
    confidence``) are put in by their keys, the last answer's wins; relations whose ends are one entity go.
    ``states`` (``note_id, content_hash``) remember the ``scanned`` notes (``note_id, content``).
    """
    stored = _keys(entities)
    keyed = found.withColumn("key", F.lower(F.trim("name")))
    first = F.struct("answer_id", "at", "kind", "name", "description", "aliases")
    new = keyed.join(stored, "key", "left_anti").groupBy("key").agg(F.min_by(first, F.struct("answer_id", "at")).alias("x"))
    new = settle(new.select("key", entity_id(F.col("x.kind"), F.col("x.name")).alias("id"), "x.kind", "x.name", "x.description", "x.aliases"))
    ids = settle(stored.unionByName(new.select("key", "id")))
    all_entities = entities.unionByName(new.select("id", "kind", "name", "description", "aliases", F.lit("suggested").alias("status")))

    told = keyed.join(ids, "key").select("answer_id", "at", F.col("id").alias("entity_id"), F.posexplode("evidence").alias("i", "e"))
    last = F.struct("answer_id", "at", "i")
    told = told.select("entity_id", "e.note_id", last.alias("o"), F.struct("e.book_id", "e.quote", "e.confidence").alias("v")).groupBy("entity_id", "note_id").agg(F.max_by("v", "o").alias("v"))
    told = told.select("entity_id", "note_id", "v.book_id", "v.quote", "v.confidence")
    all_evidence = evidence.join(told.select("entity_id", "note_id"), ["entity_id", "note_id"], "left_anti").select(told.columns).unionByName(told)

    ends = links.withColumns({"ka": F.lower(F.trim("from")), "kb": F.lower(F.trim("to"))})
    ends = ends.join(ids.select(F.col("key").alias("ka"), F.col("id").alias("a")), "ka").join(ids.select(F.col("key").alias("kb"), F.col("id").alias("b")), "kb").where("a <> b")
    ends = ends.withColumn("id", relation_id(F.col("a"), F.col("b"), F.col("relation")))
    put = ends.groupBy("id").agg(F.max_by(F.struct("a", "b", "relation", "summary", "confidence"), F.struct("answer_id", "at")).alias("v"), F.min_by(F.struct("a", "b"), F.struct("answer_id", "at")).alias("f"))
    # the ends stay in the direction in which the relation first came
    was = relations.select("id", F.struct("a", "b").alias("was"))
    put = put.join(was, "id", "left").select("id", F.coalesce("was.a", "f.a").alias("a"), F.coalesce("was.b", "f.b").alias("b"), "v.relation", "v.summary", "v.confidence")
    all_relations = relations.join(put.select("id"), "id", "left_anti").select(put.columns).unionByName(put)

    now = scanned.select("note_id", F.md5("content").alias("content_hash")).groupBy("note_id").agg(F.max("content_hash").alias("content_hash"))
    all_states = states.join(now.select("note_id"), "note_id", "left_anti").select("note_id", "content_hash").unionByName(now)
    return all_entities, all_evidence, all_relations, all_states


def unchanged(notes: DataFrame, states: DataFrame) -> DataFrame:
    """``note_id`` of the notes whose content is that of their last scan."""
    return notes.select("note_id", F.md5("content").alias("content_hash")).join(states, ["note_id", "content_hash"], "left_semi").select("note_id")


# ---- corrections ----------------------------------------------------------


def correct(entities: DataFrame, edits: DataFrame) -> DataFrame:
    """``entities`` with the ``edits`` (``id, name, description, status, aliases``, null: as it is) put in, one edit for an id.

    Names are put on one line and cut; new aliases come after those there are.
    Edits with a blank name, an unknown state or an unknown id are an error.
    """
    bad = edits.where((F.col("name").isNotNull() & _name(F.col("name")).isNull()) | ~F.coalesce(F.col("status").isin(STATUSES), F.lit(True)))
    if not bad.isEmpty() or not edits.join(entities, "id", "left_anti").isEmpty():
        raise ValueError("an edit needs a known concept, a name that isn't blank and a known state")
    e = edits.select("id", _name(F.col("name")).alias("n"), F.substring("description", 1, 2 * QUOTE_CHARS).alias("d"), F.col("status").alias("s"), F.coalesce("aliases", F.array().cast("array<string>")).alias("more"))
    j = entities.join(e, "id", "left").withColumn("name", F.coalesce("n", "name"))
    more = F.filter(F.transform("more", lambda a: F.trim(F.substring(F.trim(F.regexp_replace(a, r"\s+", " ")), 1, NAME_CHARS))), lambda a: (a != "") & (a != F.col("name")))
    old = F.coalesce("aliases", F.array().cast("array<string>"))
    new = F.array_except(F.array_distinct(more), old)
    aliases = F.when(F.col("more").isNotNull(), F.concat(old, new)).otherwise(F.col("aliases"))
    put = {"aliases": aliases, "description": F.coalesce("d", "description"), "status": F.coalesce("s", "status")}
    return j.withColumns(put).select(entities.columns)


def merge_targets(requests: DataFrame) -> DataFrame:
    """``source, target``: where each concept of the merge requests ``source, target`` ends, chains followed to their end.

    Pointers are doubled: a chain of n requests takes log2(n) joins. Requests
    must be one for a source; those that lead in a circle are an error.
    """
    r = requests.select("source", "target").where("source <> target").distinct()
    n = r.count()
    if r.select("source").distinct().count() != n:
        raise ValueError("a concept can be merged into one other only")
    now, hops = settle(r), 1
    while True:
        on = now.select(F.col("source").alias("target"), F.col("target").alias("next"))
        more = settle(now.join(on, "target", "left").select("source", F.coalesce("next", "target").alias("target"), F.col("next").isNotNull().alias("moved")))
        if more.where("moved").isEmpty():
            return now.select("source", "target")
        hops *= 2
        if hops > 2 * n:
            raise ValueError("merge requests lead in a circle")
        now = more.select("source", "target")


def merge(entities: DataFrame, evidence: DataFrame, relations: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after all merge requests ``source, target``, taken together.

    Sources are merged in the order of their ids. Evidence moves to the target;
    of one note the greatest confidence stays, with the quote that came last.
    Relations are rewritten, those within one concept go, of one undirected pair
    and kind the smallest id stays. The target takes the sources' names and
    aliases as aliases and the last description that isn't blank.
    """
    to = settle(merge_targets(requests))

    def moved(rows: DataFrame, column: str) -> DataFrame:
        target = to.select(F.col("source").alias(column), F.col("target").alias("_t"))
        out = rows.join(target, column, "left")
        return out.withColumns({"_from": F.when(F.col("_t").isNotNull(), F.col(column)), column: F.coalesce("_t", column)}).drop("_t")

    came = F.struct(F.col("_from").isNotNull(), F.coalesce("_from", F.lit("")))  # the target's own first
    ev = moved(evidence, "entity_id").groupBy("entity_id", "note_id").agg(F.min_by("book_id", came).alias("book_id"), F.max_by("quote", came).alias("quote"), F.max("confidence").alias("confidence"))
    rel = moved(moved(relations, "a").drop("_from"), "b").drop("_from").where("a <> b")
    keep = rel.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), F.col("relation").alias("r")).agg(F.min("id").alias("id")).select("id")
    rel = rel.join(keep, "id", "left_semi").select(relations.columns)
    gone = entities.join(to, F.col("id") == F.col("source"))
    names = F.array_sort(F.collect_list(F.struct(F.col("id").alias("s"), F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("n"))))
    text = F.max_by("description", F.when(F.col("description") != "", F.col("id")))
    taken = gone.groupBy(F.col("target").alias("id")).agg(F.flatten(names["n"]).alias("more"), text.alias("text"))
    j = entities.join(to.select(F.col("source").alias("id")), "id", "left_anti").join(taken, "id", "left")
    old = F.coalesce("aliases", F.array().cast("array<string>"))
    more = F.array_except(F.array_distinct(F.filter(F.transform("more", lambda a: F.trim(a)), lambda a: (a != "") & (a != F.col("name")))), old)
    aliases = F.when(F.col("more").isNotNull(), F.concat(old, more)).otherwise(F.col("aliases"))
    return j.withColumns({"aliases": aliases, "description": F.coalesce("text", "description")}).select(entities.columns), ev, rel


def clear_suggested(entities: DataFrame, evidence: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the suggested concepts and all that hangs on them."""
    gone = entities.where("status = 'suggested'").select("id")
    without = lambda d, c: d.join(gone.withColumnRenamed("id", c), c, "left_anti").select(d.columns)
    return entities.where("status <> 'suggested'"), without(evidence, "entity_id"), without(without(relations, "a"), "b")


# ---- the graph ------------------------------------------------------------


def relations_between(relations: DataFrame, entities: DataFrame, shown: DataFrame, least: float = 0.0, hidden: bool = False) -> DataFrame:
    """Relations of ``least`` confidence with both ends among ``shown`` (``id``), hidden concepts' only if asked for."""
    ids = shown.select("id")
    if not hidden:
        ids = ids.join(entities.where("status = 'hidden'").select("id"), "id", "left_anti")
    r = relations.where(F.col("confidence") >= least)
    return r.join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi").select(relations.columns)


def concept_graph(entities: DataFrame, evidence: DataFrame, relations: DataFrame, kinds: list[str] | None = None, book_id: str | None = None, least: float = 0.0, limit: int = SHOWN, hidden: bool = False, centre: str | None = None, many: int = MANY) -> tuple[DataFrame, DataFrame]:
    """The concepts of a view (``id, kind, name, status, updated_at, evidence_count, total, truncated``) and the relations between them.

    With a ``centre``: it and its neighbours, by description and id; hidden ones are left out after the limit.
    Else: concepts with evidence of ``least`` confidence, newest first, ties by id. ``total`` counts all that
    aren't hidden, whatever else is asked for; beyond ``many`` of them the confidence asked for is at least SURE.
    """
    unknown = set(kinds or ()) - set(ENTITY_KINDS)
    if unknown:
        raise ValueError(f"unknown kinds: {sorted(unknown)}")
    least, limit = max(0.0, min(1.0, least)), max(1, min(MOST_SHOWN, limit))
    counts = evidence.groupBy(F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("evidence_count"))
    columns = ["id", "kind", "name", "status", "updated_at", "evidence_count", "total", "truncated"]
    full = lambda d: d.join(counts, "id", "left").withColumn("evidence_count", F.coalesce("evidence_count", F.lit(0)))
    if centre:
        near = relations.where(F.col("b") == centre).select(F.col("a").alias("id")).union(relations.where(F.col("a") == centre).select("b")).union(entities.where(F.col("id") == centre).select("id")).distinct()
        picked = settle(full(entities.join(near, "id", "left_semi")).orderBy("description", "id").limit(limit))
        shown = picked if hidden else picked.where("status <> 'hidden'")
        nodes = shown.withColumns({"total": F.lit(picked.count()), "truncated": F.lit(False)}).select(columns)
        return nodes, relations_between(relations, entities, picked, least, hidden)
    visible = entities if hidden else entities.where("status <> 'hidden'")
    total = visible.count()
    truncated = total > many
    least = max(least, SURE) if truncated else least
    rows = visible.where(F.col("kind").isin(kinds)) if kinds else visible
    if book_id:
        rows = rows.join(evidence.where(F.col("book_id") == book_id).select(F.col("entity_id").alias("id")), "id", "left_semi")
    rows = rows.join(evidence.where(F.col("confidence") >= least).select(F.col("entity_id").alias("id")), "id", "left_semi")
    nodes = settle(full(rows.orderBy(F.desc("updated_at"), "id").limit(limit)).withColumns({"total": F.lit(total), "truncated": F.lit(truncated)}).select(columns))
    return nodes, relations_between(relations, entities, nodes, least, hidden)
