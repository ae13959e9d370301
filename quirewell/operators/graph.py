"""Relation graphs: shared terms, shared metadata, near vectors, and concept graphs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bigrams, char_pairs, cosine, graph_words, normalize_search, same_work, title_key, version_key
from .library import settle, top_per_group


#: Keys that are broadcast at most, rows of a block of one key from which a key has several, blocks of a key, rows that a block holds at most, units of all keys, and pairs that a task makes.
BROADCAST_KEYS, KEY_BLOCK, KEY_PARTS, KEY_MOST, UNITS, TASK_PAIRS = 200_000, 4096, 16, 131_072, 1024, 20_000_000


def posting_pairs(postings: DataFrame, key: str, node: str, least: int = 2, most: int = 50, *carry: str) -> DataFrame:
    """Pairs ``a < b`` of nodes that share a key with ``least`` to ``most`` nodes; the bound keeps a hot key from squaring.

    Postings are never broadcast, whatever size Spark takes them for: files of
    few distinct values say little about their rows. Only keys within the bounds
    are, if they are few, so that hot ones go before anything is shuffled.
    """
    n = settle(postings.groupBy(key).agg(F.count_distinct(node).alias("n")).where(F.col("n").between(least, most)).select(key))
    p = postings.join(F.broadcast(n) if n.count() <= BROADCAST_KEYS else n.hint("merge"), key)
    a = p.select(key, F.col(node).alias("a"), *[F.col(c).alias(f"{c}_a") for c in carry])
    b = p.select(key, F.col(node).alias("b"), *[F.col(c).alias(f"{c}_b") for c in carry])
    return a.join(b.hint("merge"), key).where("a < b")


def key_pairs(rows: DataFrame, wanted: Column, *more: Column) -> DataFrame:
    """``a, b`` and ``more`` of all pairs ``a < b`` of nodes ``n`` with one key ``k`` that are ``wanted`` by their values ``vx`` and ``vy``, however many rows a key has.

    A key's rows are dealt by their hash over up to KEY_PARTS blocks of KEY_BLOCK
    or more, and every two blocks meet in a unit of their own, so a hot key is the
    work of many tasks; it has as many blocks as make its share of UNITS, since
    with many hot keys few will do. What is shuffled is lists of the nodes of one value in a
    block, each KEY_PARTS + 1 times at most, so disk follows the rows and not the
    pairs. A task holds a block of KEY_MOST at most, for which alone a key of more
    than KEY_PARTS * KEY_MOST gets more blocks; ``wanted`` and ``more`` are worked
    out once for a node and a list.
    """
    rows = rows.where("k IS NOT NULL AND v IS NOT NULL AND n IS NOT NULL")
    size = settle(rows.groupBy("k").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    pairs = size.agg(F.sum(F.col("size").cast("double") * F.col("size") / 2)).first()[0] or 0.0
    tasks = int(min(20_000, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs // TASK_PAIRS)))
    fair = F.ceil(F.col("size") * math.sqrt(UNITS / max(pairs, 1.0)))  # half the square of it is the key's share of units
    parts = F.greatest(F.least(F.lit(KEY_PARTS), fair, F.ceil(F.col("size") / KEY_BLOCK)), F.ceil(F.col("size") / KEY_MOST)).cast("int")
    large = size.where(F.col("size") > KEY_BLOCK).select("k", parts.alias("parts"))  # a key for each KEY_BLOCK rows at most
    dealt = rows.join(F.broadcast(large), "k", "left").withColumn("last", F.coalesce("parts", F.lit(1)) - 1)
    lists = dealt.groupBy("k", "v", "last", F.pmod(F.xxhash64("n"), F.col("last") + 1).cast("int").alias("at")).agg(F.sort_array(F.collect_list("n")).alias("ns"))  # in order they pack better
    left = lists.select("k", F.col("at").alias("i"), F.explode(F.sequence("at", "last")).alias("j"), F.col("v").alias("vx"), F.col("ns").alias("xs"))
    right = lists.select("k", F.explode(F.sequence(F.lit(0), "at")).alias("i"), F.col("at").alias("j"), F.col("v").alias("vy"), F.col("ns").alias("ys"))
    unit = ["k", "i", "j"]
    # a node at a time meets the lists of a block: rows that come of one row of a join are buffered before they go on
    met = left.repartition(tasks, *unit).select(*unit, "vx", F.explode("xs").alias("x")).join(right.repartition(tasks, *unit).hint("merge"), unit)
    met = met.where(F.expr("i < j OR vx <= vy") & wanted).select("x", "ys", F.expr("i < j OR vx < vy").alias("apart"), *more)  # if not apart, both orders of a pair meet
    told = [c for c in met.columns if c not in ("x", "ys", "apart")]
    each = met.select("x", F.explode("ys").alias("y"), "apart", *told).where("x <> y AND (apart OR x < y)")
    return each.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), *told)


def conflicts(rows: DataFrame, key: str, node: str, value: str) -> DataFrame:
    """All pairs ``a < b`` of nodes with one key and different values, however many rows a key has."""
    return key_pairs(rows.select(F.col(key).alias("k"), F.col(node).alias("n"), F.col(value).alias("v")), F.col("vx") != F.col("vy"))


def mean_vectors(embeddings: DataFrame, group: str = "book_id", vector: str = "vector") -> DataFrame:
    """Element-wise mean of each group's vectors: sums by position, combined in each task first."""
    each = embeddings.select(group, F.posexplode(vector).alias("i", "x"))
    means = each.groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("v")).select(group, F.col("v.m").alias("mean"))


def semantic_edges(embeddings: DataFrame, least: float = 0.35) -> DataFrame:
    """Pairs of books by the cosine of their mean vectors: one row per book, so all pairs of them are few."""
    m = mean_vectors(embeddings)
    a, b = m.select(F.col("book_id").alias("a"), F.col("mean").alias("va")), m.select(F.col("book_id").alias("b"), F.col("mean").alias("vb"))
    score = cosine(F.col("va"), F.col("vb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(score, 6).alias("score")).where(F.col("score") >= least)


def semantic_relations(embeddings: DataFrame, least: float = 0.35, thoughts: float = 0.48) -> DataFrame:
    """``id, a, b, score, relation``: books near by all their notes, and those near by their readers' own thoughts alone."""
    all_ = semantic_edges(embeddings, least)
    label = F.when(F.col("score") >= 0.72, "much alike").when(F.col("score") >= 0.52, "alike").otherwise("perhaps related")
    own = semantic_edges(embeddings.where("note_type = 'thought'"), thoughts)
    named = lambda d, start, relation: d.select(F.concat(F.lit(start), "a", F.lit(":"), "b").alias("id"), "a", "b", "score", relation.alias("relation"))
    return named(all_, "semantic:", label).unionByName(named(own, "semantic:thought:", F.lit("readers' thoughts")))


def author_edges(books: DataFrame, least: int = 2, most: int = 80, works_too: bool = False) -> DataFrame:
    """Books of one author, weight .92; two names of one work make no relation, unless ``works_too``."""
    keyed = books.where("trim(coalesce(author, '')) <> ''").withColumn("key", title_key(F.col("title")))
    pairs = posting_pairs(keyed, "author", "book_id", least, most, "key")
    pairs = pairs if works_too else pairs.where(~same_work(F.col("key_a"), F.col("key_b")))
    return pairs.select("a", "b", "author", F.lit(0.92).alias("score"))


def metadata_edges(meta: DataFrame, labels: int = 6) -> DataFrame:
    """``a, b, kind, score, labels``: an edge for each kind of what two books share, however many books share it.

    ``authors`` .94, ``translators`` .90, ``subjects`` .48 + .08 for each of them,
    .88 at most. Names are trimmed and in lower case; up to ``labels`` of them,
    in order, are told and count. Two books meet under each name that they
    share and make their edge under the first.
    """
    kinds = {"author": "authors", "translator": "translators", "subject": "subjects"}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(c), F.array().cast("array<string>")).alias("names")) for k, c in kinds.items()]))
    named = meta.select("book_id", each.alias("x")).select("book_id", "x.kind", F.explode("x.names").alias("label"))
    named = named.select("book_id", "kind", F.lower(F.trim("label")).alias("label")).where("label <> ''")
    held = settle(named.groupBy("book_id", "kind").agg(F.array_sort(F.collect_set("label")).alias("v")))
    rows = held.select("kind", "v", F.col("book_id").alias("n"), F.explode("v").alias("label")).select(F.struct("kind", "label").alias("k"), "v", "n")
    shared, kind = F.array_intersect("vx", "vy"), F.col("k.kind")
    told = F.slice(shared, 1, labels)
    score = F.when(kind == "author", 0.94).when(kind == "translator", 0.90).otherwise(F.least(F.lit(0.88), F.round(0.48 + 0.08 * F.size(told), 6)))
    return key_pairs(rows, shared[0] == F.col("k.label"), kind.alias("kind"), score.alias("score"), told.alias("labels"))


def same_works(titles: DataFrame, gram: int = 4) -> DataFrame:
    """``a, b, books_a, books_b``: pairs of different keys (``key``) of which one contains the other, both of four characters or more.

    A key that is contained has all its runs of four characters in the other,
    so it meets only keys that have the rarest of them: no pair is looked at that
    doesn't share it. Books of equal keys are one work and counted in ``books``.
    """
    keys = settle(titles.where(F.char_length("key") >= gram).groupBy("key").agg(F.count(F.lit(1)).alias("books")))
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("key") - (gram - 1)), lambda i: F.substring(F.col("key"), i, F.lit(gram))))
    held = settle(keys.select("key", "books", F.explode(runs).alias("run")))
    often = held.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    rarest = held.join(often, "run").groupBy("key").agg(F.min_by("run", F.struct("n", "run")).alias("run"), F.first("books").alias("books"))
    near = rarest.select(F.col("key").alias("short"), F.col("books").alias("n_short"), "run").join(held.select(F.col("key").alias("long"), F.col("books").alias("n_long"), "run"), "run")
    near = near.where((F.char_length("long") > F.char_length("short")) & F.contains("long", F.col("short")))
    first = F.col("short") < F.col("long")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    return near.select(pick("short", "long").alias("a"), pick("long", "short").alias("b"), pick("n_short", "n_long").alias("books_a"), pick("n_long", "n_short").alias("books_b"))


def intro_edges(intros: DataFrame, shared: int = 4, least: float = 0.18, posting_most: int = 60) -> DataFrame:
    """Introductions by the share of their distinct bigrams: n / sqrt(size a * size b), .92 at most.

    A book's bigrams are distinct, so postings are plain counts; only rare
    ones (2 to ``posting_most`` books) make pairs, and these carry no sizes:
    pairs with ``shared`` of them get those at the end.
    """
    d = settle(intros.where("char_length(description) >= 40").select("book_id", bigrams(normalize_search(F.col("description"))).alias("g")))
    p = d.select(F.xxhash64("book_id").alias("h"), F.explode("g").alias("k"))
    holders = p.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, posting_most)).select("k")
    rare = p.join(F.broadcast(holders) if holders.count() <= 200_000 else holders, "k")
    lists = rare.groupBy("k").agg(F.sort_array(F.collect_list("h")).alias("l"))  # posting_most at most
    mates = F.flatten(F.transform("l", lambda x, i: F.transform(F.slice("l", i + 2, posting_most), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    pairs = lists.select(F.explode(mates).alias("p")).groupBy("p.x", "p.y").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= shared)
    size = d.select("book_id", F.xxhash64("book_id").alias("h"), F.size("g").cast("double").alias("size"))
    side = lambda k: size.select(F.col("h").alias(k), F.col("book_id").alias(f"b_{k}"), F.col("size").alias(f"s_{k}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y")
    score = F.col("n") / F.sqrt(F.col("s_x") * F.col("s_y"))
    return both.where(score >= least).select(F.least("b_x", "b_y").alias("a"), F.greatest("b_x", "b_y").alias("b"), "n", F.round(F.least(F.lit(0.92), score), 6).alias("score"))


def term_weights(words: DataFrame, books: int, top: int = 120, common: float = 0.45) -> DataFrame:
    """``book_id, term, weight``: (1 + ln tf) * ln(1 + N / df) of the heaviest terms; terms in ``common`` of the books or more go."""
    tf = words.groupBy("book_id", "term").agg(F.sum("w").alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") < common * books)
    weight = (1 + F.log("tf")) * F.log(1 + F.lit(float(books)) / F.col("df"))
    w = tf.join(df, "term").withColumn("weight", F.round(weight, 9))
    rank = Window.partitionBy("book_id").orderBy(F.desc("weight"), "term")
    return w.withColumn("rn", F.row_number().over(rank)).where(F.col("rn") <= top).select("book_id", "term", "weight")


def lexical_edges(weights: DataFrame, least: float = 0.02, shared: int = 2, posting_most: int = 50) -> DataFrame:
    """Cosine of term weights for pairs of books that share terms; long postings make no pairs but count in the norms."""
    norms = weights.groupBy("book_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    pairs = posting_pairs(weights, "term", "book_id", 2, posting_most, "weight")
    dots = pairs.groupBy("a", "b").agg(F.sum(F.col("weight_a") * F.col("weight_b")).alias("dot"), F.count(F.lit(1)).alias("shared"))
    scored = dots.join(norms.toDF("a", "na"), "a").join(norms.toDF("b", "nb"), "b").withColumn("score", F.round(F.col("dot") / (F.col("na") * F.col("nb")), 6))
    return scored.where((F.col("score") >= least) & (F.col("shared") >= shared)).select("a", "b", "shared", "score")


def degree(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("node")).union(edges.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def degree_cap(edges: DataFrame, cap: int) -> DataFrame:
    """Edges by falling score, each kept if both ends still have fewer than ``cap``: what a scan in that order keeps.

    Decided in rounds: an edge stays for certain if at both ends the kept edges
    and the open ones before it are fewer than ``cap``, and goes once an end is
    full. The first open edge is always decided, so the rounds end; mostly
    each decides many of every node's edges. Ties go to the smaller ends. An
    edge that is listed twice counts twice.
    """
    open_, kept = settle(edges.select("a", "b", "score").withColumn("no", F.monotonically_increasing_id())), []
    order = [F.desc("score"), F.asc("a"), F.asc("b"), F.asc("no")]
    while not open_.isEmpty():
        ends = open_.select("*", F.explode(F.array("a", "b")).alias("node"))
        rank = ends.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(*order)))
        used = _used(kept)
        rank = rank.join(used, "node", "left") if used is not None else rank.withColumn("used", F.lit(0))
        taken = F.coalesce("used", F.lit(0))
        state = rank.groupBy("no", "a", "b", "score").agg(F.max(taken + F.col("rank")).alias("place"), F.max(taken).alias("used"))
        state = settle(state.where(F.col("used") < cap))
        kept.append(state.where(F.col("place") <= cap).select("a", "b", "score"))
        open_ = settle(state.where(F.col("place") > cap).select("a", "b", "score", "no"))
    return reduce(DataFrame.union, kept) if kept else edges.select("a", "b", "score")


def _used(kept: list[DataFrame]) -> DataFrame | None:
    """``node, used``: how many of the kept edges a node has."""
    return degree(reduce(DataFrame.union, kept)).withColumnRenamed("degree", "used") if kept else None


def best_evidence(embeddings: DataFrame, edges: DataFrame) -> DataFrame:
    """``book_id, other, note_id``: for both books of an edge the note nearest, by cosine, to the other book's mean; ties to the smaller id."""
    both = edges.select(F.col("a").alias("book_id"), F.col("b").alias("other")).union(edges.select("b", "a"))
    means = mean_vectors(embeddings).select(F.col("book_id").alias("other"), "mean")
    near = F.round(cosine(F.col("vector"), F.col("mean")), 9)
    rows = embeddings.join(both.join(means, "other"), "book_id").select("book_id", "other", "note_id", near.alias("near"))
    return rows.groupBy("book_id", "other").agg(F.min_by("note_id", F.struct(-F.col("near"), F.col("note_id"))).alias("note_id"))


def book_terms(books: DataFrame, notes: DataFrame, newest: int = 250, chars: int = 800) -> DataFrame:
    """``book_id, term, w``: words weighted by where they stand: title 1.2, author 2.5, category 4; of the newest notes chapter 1.5, content 1, own thoughts 2.2."""
    n = top_per_group(notes, "book_id", newest, F.desc("created"), F.asc("note_id"))
    part = lambda d, text, w: d.select("book_id", F.explode(graph_words(text)).alias("term"), w.alias("w"))
    own = F.when(F.col("note_type") == "thought", 2.2).otherwise(1.0)
    parts = [part(books, F.col("title"), F.lit(1.2)), part(books, F.col("author"), F.lit(2.5)), part(books, F.col("category"), F.lit(4.0)), part(n, F.col("chapter"), F.lit(1.5)), part(n, F.substring("content", 1, chars), own)]
    words = parts[0]
    for x in parts[1:]:
        words = words.union(x)
    return words.groupBy("book_id", "term").agg(F.round(F.sum("w"), 6).alias("w"))


def note_matches(notes: DataFrame, keywords: list[str], chars: int = 1200) -> DataFrame:
    """``note_id, matched, score``: the keywords in a note's chapter and beginning, .2 more for a thought; notes without any are left out."""
    words = graph_words(F.concat_ws(" ", F.coalesce("chapter", F.lit("")), F.substring("content", 1, chars)))
    matched = F.array_intersect(F.array(*[F.lit(k) for k in keywords]), words)
    rows = notes.select("note_id", "book_id", "chapter", "note_type", matched.alias("matched")).where(F.size("matched") > 0)
    return rows.withColumn("score", F.size("matched") + F.when(F.col("note_type") == "thought", 0.2).otherwise(0.0))


def lexical_relations(books: DataFrame, notes: DataFrame, weights: DataFrame, least: float = 0.02, posting_most: int = 50, newest: int = 250, chars: int = 1200) -> DataFrame:
    """``a, b, cosine, keywords, notes, chapters, score, relation`` of books that share terms and have notes of both sides to show for it.

    Up to 16 shared terms, heaviest first; of them up to five that notes of both
    books have are the keywords, two at least. Score: .55 cosine, .20 keywords,
    .15 notes, .10 chapters. Two names of one work make no relation.
    """
    norms = weights.groupBy("book_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    about = books.join(norms, "book_id").select("book_id", "norm", "author", title_key(F.col("title")).alias("key"))
    product = F.round(F.col("weight_a") * F.col("weight_b"), 9)
    pairs = posting_pairs(weights, "term", "book_id", 2, posting_most, "weight").groupBy("a", "b").agg(F.sum(F.col("weight_a") * F.col("weight_b")).alias("dot"), F.array_sort(F.collect_list(F.struct((-product).alias("w"), "term"))).alias("terms"))  # 120 at most
    side = lambda x: about.select(F.col("book_id").alias(x), F.col("norm").alias(f"n{x}"), F.col("author").alias(f"w{x}"), F.col("key").alias(f"k{x}"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("cosine", F.round(F.col("dot") / (F.col("na") * F.col("nb")), 6))
    pairs = pairs.where((F.col("cosine") >= least) & (F.size("terms") >= 2) & ~same_work(F.col("ka"), F.col("kb")))
    pairs = settle(pairs.select("a", "b", "cosine", F.slice("terms.term", 1, 16).alias("shared"), ((F.col("wa") == F.col("wb")) & (F.col("wa") != "")).alias("one_author")))
    n = top_per_group(notes, "book_id", newest, F.desc("created"), F.asc("note_id"))
    words = F.array_distinct(graph_words(F.concat_ws(" ", F.coalesce("chapter", F.lit("")), F.substring("content", 1, chars))))
    # a note's words that can be shared are few: those of its book's heaviest terms
    heavy = weights.groupBy("book_id").agg(F.collect_list("term").alias("heavy"))
    n = n.join(heavy, "book_id").select("book_id", F.coalesce("chapter", F.lit("")).alias("chapter"), F.array_intersect(words, "heavy").alias("words"))
    sides = pairs.select("a", "b", "shared", F.explode(F.array("a", "b")).alias("book_id"))
    hits = settle(sides.join(n, "book_id").select("a", "b", "book_id", "chapter", F.array_intersect("shared", "words").alias("matched")).where(F.size("matched") > 0))
    told = hits.groupBy("a", "b", "book_id").agg(F.collect_set(F.array_join("matched", " ")).alias("sets")).select("a", "b", "book_id", F.array_distinct(F.split(F.array_join("sets", " "), " ")).alias("told"))
    both = told.groupBy("a", "b").agg(F.collect_list("told").alias("t")).where(F.size("t") == 2)
    keyed = pairs.join(both, ["a", "b"]).withColumn("keywords", F.slice(F.filter("shared", lambda w: F.array_contains(F.col("t")[0], w) & F.array_contains(F.col("t")[1], w)), 1, 5)).where(F.size("keywords") >= 2).drop("t", "shared")
    shown = hits.join(keyed.select("a", "b", "keywords"), ["a", "b"]).where(F.arrays_overlap("matched", "keywords")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("notes"), F.count_distinct("book_id", "chapter").alias("chapters"))
    share = lambda c, n: F.least(F.lit(1.0), c / F.lit(float(n)))
    score = F.round(0.55 * F.col("cosine") + 0.20 * share(F.size("keywords"), 5) + 0.15 * share(F.col("notes"), 6) + 0.10 * share(F.col("chapters"), 4), 6)
    out = keyed.join(shown, ["a", "b"]).withColumn("score", score)
    relation = F.when(F.col("one_author"), "same author").when(F.col("score") >= 0.28, "much alike").when(F.col("score") >= 0.12, "alike").otherwise("perhaps related")
    return out.select("a", "b", "cosine", "keywords", "notes", "chapters", "score", relation.alias("relation"))


def version_edges(meta: DataFrame) -> DataFrame:
    """Editions of one work (``book_id, title, isbn``): 2 to 12 books of one ``version_key``, not of one ISBN, weight .86."""
    keyed = meta.select("book_id", F.coalesce("isbn", F.lit("")).alias("isbn"), version_key(F.col("title")).alias("key")).where("key IS NOT NULL")
    pairs = posting_pairs(keyed, "key", "book_id", 2, 12, "isbn")
    return pairs.where("isbn_a = '' OR isbn_a <> isbn_b").select("a", "b", F.lit(0.86).alias("score"))


def filter_view(edges: DataFrame, books: DataFrame, least: float = 0.0, source: str = "all", kind: str = "all", focus: str | None = None, strength: str = "all") -> DataFrame:
    """The edges ``id, a, b, score, relation`` that a view shows, best first.

    ``source``: local, semantic or the name of a metadata source; ``kind``:
    author, content, or analyzable (both books have notes); with a ``focus`` the
    5, 10, 12 or 20 best of its edges (strong, balanced, standard, wide).
    """
    known = books.select("book_id")
    e = edges.where(F.col("score") >= least).join(known.toDF("a"), "a", "left_semi").join(known.toDF("b"), "b", "left_semi")
    if source == "local":
        e = e.where(~F.startswith("id", F.lit("semantic:")) & ~F.startswith("id", F.lit("metadata:")))
    elif source != "all":
        e = e.where(F.startswith("id", F.lit("semantic:" if source == "semantic" else f"metadata:{source}:")))
    if kind in ("author", "content"):
        e = e.where(F.contains("relation", F.lit("author")) == F.lit(kind == "author"))
    elif kind == "analyzable":
        full = books.where("highlight_count + thought_count > 0").select("book_id")
        e = e.join(full.toDF("a"), "a", "left_semi").join(full.toDF("b"), "b", "left_semi")
    if strength == "all":
        return e
    most = {"strong": 5, "balanced": 10, "standard": 12}.get(strength, 20)
    return e.where((F.col("a") == focus) | (F.col("b") == focus)).orderBy(F.desc("score"), "id").limit(most)


def relation_pick(notes: DataFrame, left: str, right: str, keywords: list[str], most: int = 12) -> DataFrame:
    """The ``most`` best notes of each of two books: ten for each keyword in content or chapter, one for a thought."""
    n = notes.where(F.col("book_id").isin(left, right))
    hits = sum((F.when(F.contains("content", F.lit(k)) | F.contains(F.coalesce("chapter", F.lit("")), F.lit(k)), 10).otherwise(0) for k in keywords if k), F.lit(0))
    scored = n.withColumn("score", hits + F.when(F.col("note_type") == "thought", 1).otherwise(0))
    return top_per_group(scored.select("book_id", "note_id", "score"), "book_id", most, F.desc("score"), F.asc("note_id")).select("book_id", "note_id", "score")


def valid_claims(claims: DataFrame, notes: DataFrame, left: str, right: str, kinds: list[str], most: int = 3, most_ids: int = 4) -> DataFrame:
    """``claim_id, kind, evidence``: the first ``most`` claims of a known kind with notes of both books; ids that are neither's go, ``most_ids`` stay."""
    own = notes.where(F.col("book_id").isin(left, right)).select("note_id", F.col("book_id"))
    each = claims.where(F.col("kind").isin(kinds)).select("claim_id", "kind", F.posexplode("evidence").alias("at", "note_id")).join(own, "note_id")
    once = each.groupBy("claim_id", "kind", "note_id", "book_id").agg(F.min("at").alias("at"))
    sides = once.groupBy("claim_id", "kind").agg(F.count_distinct("book_id").alias("sides"), F.slice(F.array_sort(F.collect_list(F.struct("at", "note_id"))), 1, most_ids).alias("e")).where("sides = 2")
    return sides.orderBy("claim_id").limit(most).select("claim_id", "kind", F.col("e.note_id").alias("evidence"))


def to_embed(notes: DataFrame, stored: DataFrame, model: str, chars: int = 1600) -> DataFrame:
    """``note_id, text, content_hash`` of the notes whose text or model changed since they were embedded (``note_id, content_hash``)."""
    text = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("chapter", F.lit("")), F.substring("content", 1, chars))
    rows = notes.select("note_id", text.alias("text")).withColumn("content_hash", F.md5(F.concat(F.lit(model + "|"), "text")))
    return rows.join(stored.select("note_id", "content_hash"), ["note_id", "content_hash"], "left_anti").select("note_id", "text", "content_hash")


def embed(rows: DataFrame, embedder, together: int = 32) -> DataFrame:
    """``note_id, content_hash, vector`` by a function from a list of texts to their vectors, called for ``together`` texts at once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), together):
                part = f.iloc[at : at + together]
                yield pd.DataFrame({"note_id": part["note_id"], "content_hash": part["content_hash"], "vector": list(embedder(part["text"].tolist()))})

    return rows.mapInPandas(run, "note_id string, content_hash string, vector array<float>")
