"""The glossary: search, saving, review states, aliases and the terms that a text names."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .library import like_any

#: States of a term.
STATUSES = ("pending", "confirmed", "ignored", "conflict", "source_missing")


def checked_status(status: str) -> str:
    if status not in STATUSES:
        raise ValueError(f"unknown state: {status}")
    return status


def search(terms: DataFrame, query: str = "", source: str = "", status: str = "", most: int | None = None) -> DataFrame:
    """Terms whose name, canonical name, definition or an alias has the query: exact names first, then newest.

    Tiers: canonical name 0, term 1, alias 2, beginning 3, else 4. ``aliases`` is an array.
    """
    q = query.strip().lower()
    alias_has = F.exists("aliases", lambda a: F.lower(a).like(f"%{q}%"))
    rows = terms.where(like_any(query, "term", "canonical_name", "definition") | alias_has)
    rows = rows.where(F.col("source") == source) if source else rows
    rows = rows.where(F.col("status") == checked_status(status)) if status else rows
    alias_is = F.exists("aliases", lambda a: F.lower(a) == q)
    tier = F.when(F.lower("canonical_name") == q, 0).when(F.lower("term") == q, 1).when(alias_is, 2).when(F.startswith(F.lower("term"), F.lit(q)), 3).otherwise(4)
    ordered = rows.withColumn("tier", tier).orderBy("tier", F.desc("updated_at"), "id")
    return ordered.limit(most) if most else ordered


def review_queue(terms: DataFrame, query: str = "", source: str = "", status: str = "") -> DataFrame:
    return search(terms, query, source, status, 200)


def set_status(terms: DataFrame, ids: DataFrame, status: str, now: Column) -> DataFrame:
    """The terms named in ``ids`` (``id``) get the state and the time."""
    mark = ids.select("id", F.lit(True).alias("chosen")).distinct()
    joined = terms.join(mark, "id", "left")
    put = lambda c, v: F.when(F.col("chosen"), v).otherwise(F.col(c)).alias(c)
    checked_status(status)
    return joined.select(*[put(c, F.lit(status)) if c == "status" else put(c, now) if c == "updated_at" else F.col(c) for c in terms.columns])


def save(terms: DataFrame, edits: DataFrame, now: Column) -> DataFrame:
    """``terms`` with the ``edits`` put in: by id, else by term, else as new ones.

    An encyclopedia's term keeps its source and is marked as edited only when
    its text changes; other terms take everything and are marked. A blank
    state keeps the old one, an unknown one is an error. Edits without a term or
    definition are left out; an id that isn't there makes a new term, numbered
    after the largest id. Of several edits of one term the last by ``seq`` stands.
    """
    unknown = edits.where((F.coalesce("status", F.lit("")) != "") & ~F.col("status").isin(*STATUSES)).select("status").first()
    if unknown:
        checked_status(unknown["status"])
    e = edits if "seq" in edits.columns else edits.withColumn("seq", F.lit(0))
    e = e.where("trim(coalesce(term, '')) <> '' AND trim(coalesce(definition, '')) <> ''")
    e = e.select("id", "seq", F.trim("term").alias("n_term"), F.trim("canonical_name").alias("n_name"), F.trim("definition").alias("n_definition"), F.col("source").alias("n_source"), F.col("status").alias("n_status"), F.col("aliases").alias("n_aliases"))
    by_term = terms.select(F.col("term").alias("n_term"), F.col("id").alias("term_id"))
    known = terms.select("id", F.col("id").alias("own_id"))
    e = e.join(known, "id", "left").join(by_term, "n_term", "left")
    at = F.when(F.coalesce("id", F.lit(0)) > 0, F.col("own_id")).otherwise(F.col("term_id"))
    e = e.withColumn("at", at).drop("id", "own_id", "term_id")
    one = Window.partitionBy("at", F.when(F.col("at").isNull(), F.col("n_term"))).orderBy(F.desc("seq"), F.desc("n_term"), F.desc("n_definition"))
    e = e.withColumn("rn", F.row_number().over(one)).where("rn = 1").drop("rn", "seq")
    changed = terms.join(e.where("at IS NOT NULL"), F.col("id") == F.col("at"), "left")
    hit, wiki = F.col("at").isNotNull(), F.col("source") == "encyclopedia"
    pick = lambda new, old: F.when(hit, new).otherwise(old)
    text_changed = (F.col("n_definition") != F.col("definition")) | (F.col("n_name") != F.col("canonical_name"))
    stored = changed.select(
        "id", pick(F.col("n_term"), F.col("term")).alias("term"), pick(F.col("n_name"), F.col("canonical_name")).alias("canonical_name"), pick(F.col("n_definition"), F.col("definition")).alias("definition"),
        pick(F.when(wiki, F.col("source")).otherwise(F.coalesce(F.nullif("n_source", F.lit("")), F.lit("manual"))), F.col("source")).alias("source"),
        pick(F.coalesce(F.nullif("n_status", F.lit("")), "status"), F.col("status")).alias("status"),
        pick(F.when(wiki, F.array_sort(F.array_union("aliases", F.coalesce("n_aliases", F.array().cast("array<string>"))))).otherwise(F.col("n_aliases")), F.col("aliases")).alias("aliases"),
        pick(F.when(wiki, F.col("manually_edited") | text_changed).otherwise(F.lit(True)), F.col("manually_edited")).alias("manually_edited"), pick(now, F.col("updated_at")).alias("updated_at"),
    )
    new = e.where("at IS NULL").select("n_term", "n_name", "n_definition", "n_source", "n_status", "n_aliases")
    largest = terms.agg(F.coalesce(F.max("id"), F.lit(0)).alias("largest"))
    number = F.col("largest") + F.row_number().over(Window.orderBy("n_term"))  # a user's edits: few rows
    fresh = new.crossJoin(F.broadcast(largest)).select(  # one row
        number.alias("id"), F.col("n_term").alias("term"), F.col("n_name").alias("canonical_name"), F.col("n_definition").alias("definition"), F.coalesce(F.nullif("n_source", F.lit("")), F.lit("manual")).alias("source"),
        F.coalesce(F.nullif("n_status", F.lit("")), F.lit("confirmed")).alias("status"), F.col("n_aliases").alias("aliases"), F.lit(True).alias("manually_edited"), now.alias("updated_at"),
    )
    return stored.unionByName(fresh)


def sync_aliases(aliases: DataFrame, manual: DataFrame) -> DataFrame:
    """``term_id, aliases``: stored and manual aliases ``term_id, alias``, each spelling once, in order."""
    all_ = aliases.select("term_id", F.trim("alias").alias("alias")).union(manual.select("term_id", F.trim("alias"))).where("alias <> ''")
    once = all_.groupBy("term_id", F.lower("alias").alias("k")).agg(F.min("alias").alias("alias"))
    return once.groupBy("term_id").agg(F.sort_array(F.collect_list("alias")).alias("aliases"))


def named_in(terms: DataFrame, text: str, most: int = 8) -> DataFrame:
    """``n, term, definition`` of the newest confirmed terms that the text names by term, canonical name or alias."""
    whole = F.lit(text.lower())
    names = F.filter(F.concat(F.array("term", "canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: F.trim(F.coalesce(x, F.lit(""))) != "")
    hit = terms.where((F.col("status") == "confirmed") & F.exists(names, lambda x: F.contains(whole, F.lower(x))))
    top = hit.orderBy(F.desc("updated_at"), "id").limit(most)
    display = F.coalesce(F.nullif("canonical_name", F.lit("")), "term")
    return top.select(F.row_number().over(Window.orderBy(F.desc("updated_at"), "id")).alias("n"), display.alias("term"), F.substring("definition", 1, 8000).alias("definition"))


#: Bytes of the terms that one automaton holds.
AUTOMATON_BYTES = 4 << 20


def named_pairs(texts: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, term_id`` for every text and the terms (``term_id, term``, lower case) that it contains, by an automaton over all terms.

    Terms are dealt into shards of AUTOMATON_BYTES or so; each goes to every
    task once, as a broadcast variable, and texts are streamed past it where they
    are. Nothing is sent along with a text. A null text names nothing.
    """
    spark = texts.sparkSession
    named = terms.select("term_id", "term").where("term <> ''")
    weigh = named.agg(F.sum(F.octet_length("term") + 16).alias("n")).first()["n"] or 0
    shards = max(1, -(-int(weigh) // AUTOMATON_BYTES))
    rows = texts.select(F.col(id_col).alias("id"), F.lower(text_col).alias("text")).where("text IS NOT NULL")
    kinds = f"id {rows.schema['id'].dataType.simpleString()}, term_id {terms.schema['term_id'].dataType.simpleString()}"

    def search(shard: int) -> DataFrame:
        held = named.where(F.pmod(F.xxhash64("term"), F.lit(shards)) == shard)
        listed = spark.sparkContext.broadcast([(r["term"], r["ids"]) for r in held.groupBy("term").agg(F.array_sort(F.collect_set("term_id")).alias("ids")).collect()])  # AUTOMATON_BYTES or so

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for term, ids in listed.value:
                automaton.add_word(term, ids)
            automaton.make_automaton()
            for f in frames:
                found = [(i, t) for i, text in zip(f["id"], f["text"], strict=True) for t in sorted({t for _, ids in automaton.iter(text) for t in ids})] if len(automaton) else []
                yield pd.DataFrame(found, columns=["id", "term_id"])

        return rows.mapInPandas(run, kinds)

    return reduce(DataFrame.unionByName, map(search, range(shards)))
