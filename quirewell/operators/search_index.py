"""A persisted inverted index: posting blocks by term, BM25 with early termination, deltas and compaction.

A folder holds generations. Each has ``docs`` (id, length, block), ``postings``
(a row for each term and block of documents: ids, frequencies and lengths, and
their extremes, in buckets by term, sorted) and ``gone``, the ids that it
replaces or removes in earlier ones. A generation counts once its line of the
``manifest`` is written; a batch that failed before leaves the index as it was.

Documents of like length share a block, so that a block's extremes say much
about its scores. A query reads the extremes of its terms only: they give a
score that the k-th best document reaches at least, and an upper bound for each
block; blocks below it are not read.
"""

from __future__ import annotations

import unicodedata
import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import folders

#: Usual constants of BM25.
K1, B = 1.2, 0.75
TOKEN = r"[\p{L}\p{N}]+"
#: Columns of the tables of a generation; a table may have no rows, and so no files.
SCHEMAS = {
    "docs": "id {id}, len int, block int",
    "postings": "term string, block int, n bigint, tf_most int, tf_least int, len_least int, len_most int, entries array<struct<id:{id},tf:int,len:int>>, bucket int",
    "gone": "id {id}",
}
#: Ids of replaced documents that are broadcast at most.
BROADCAST_IDS = 1_000_000
#: Documents of a block, least ones where there are few documents, blocks of a task that writes postings, and ids of blocks that are broadcast at most.
BLOCK, LEAST_BLOCK, TOGETHER, BROADCAST_BLOCKS = 4096, 256, 16, 500_000


def _folding() -> tuple[str, str]:
    """Latin letters with marks and what they are without; combining marks, which go, come last."""
    marked = [chr(c) for a, b in ((0xC0, 0x250), (0x1E00, 0x1F00)) for c in range(a, b)]
    plain = {c: unicodedata.normalize("NFD", c)[0].lower() for c in marked}
    plain = {c: x for c, x in plain.items() if x != c and x.isascii()}
    return "".join(plain) + "".join(map(chr, range(0x300, 0x370))), "".join(plain.values())


FOLD_FROM, FOLD_TO = _folding()
_FOLD = str.maketrans(FOLD_FROM[: len(FOLD_TO)], FOLD_TO, FOLD_FROM[len(FOLD_TO) :])


def folded(text: Column) -> Column:
    """Lower case without the marks of Latin letters."""
    return F.translate(F.lower(text), FOLD_FROM, FOLD_TO)


def fold(text: str) -> str:
    return text.lower().translate(_FOLD)


def words(*fields: str) -> Column:
    """All words of the fields, folded."""
    text = folded(F.concat_ws(" ", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]))
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


class SearchIndex:
    """The index in a folder; ``build`` makes one, ``update`` adds a generation, ``match`` asks it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, rows: DataFrame, path: str, id_col: str, fields: tuple[str, ...], buckets: int = 16) -> SearchIndex:
        """An index of ``rows``, one row per id. Null fields count as empty; documents without words count in the statistics."""
        index = cls(rows.sparkSession, path)
        index._add(0, 0, *index._written(0, rows, id_col, fields), None, buckets)
        return index

    # ---- generations ------------------------------------------------------

    def manifest(self) -> list[dict]:
        """The generations that count, oldest first: those from the last compaction on."""
        if not folders.exists(self.spark, f"{self.path}/manifest"):
            return []
        all_ = sorted((r.asDict() for r in self.spark.read.parquet(f"{self.path}/manifest").collect()), key=lambda r: r["gen"])
        return [r for r in all_ if r["gen"] >= all_[-1]["base"]]

    def _at(self, gen: int, what: str) -> str:
        return f"{self.path}/gen={gen}/{what}"

    def _read(self, line: dict, what: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[what].format(id=line["id_type"])).parquet(self._at(line["gen"], what))

    def _written(self, gen: int, rows: DataFrame, id_col: str, fields: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
        """``id, len`` of the documents, and ``id, len, said``: the words, written as one text, so that they are found once and moved as such."""
        found = rows.select(F.col(id_col).alias("id"), words(*fields).alias("w"))
        said = folders.write(found.select("id", F.size("w").alias("len"), F.array_join("w", " ").alias("said")), self._at(gen, "said"))
        return said.select("id", "len"), said

    def _add(self, gen: int, base: int, lens: DataFrame, said: DataFrame, gone: DataFrame | None, buckets: int) -> None:
        """Write generation ``gen`` from ``id, len`` and the documents' words (``said``) or, if they are counted, the entries ``id, term, tf, len``.

        A document's block follows from its length and the hash of its id, so the
        words are dealt out by block once; all postings of a block are made where
        it is, and only they are dealt out once more, by bucket.
        """
        ids = lens.select("id")
        by_len = folders.write(lens.groupBy("len").agg(F.count(F.lit(1)).alias("n")), self._at(gen, "lens"))
        n = by_len.agg(F.sum("n")).first()[0] or 0
        size = min(BLOCK, max(LEAST_BLOCK, -(-n // (4 * self.spark.sparkContext.defaultParallelism))))
        before = F.coalesce(F.sum("n").over(Window.orderBy("len").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # of the lengths, a row each
        # a length of many documents has blocks of its own, others share one
        alone = F.ceil(F.col("n") / size)
        spread = by_len.withColumn("first", F.floor(before / size)).select("len", "first", F.when(alone > 1, alone).otherwise(1).alias("parts"))
        blocks = max(1, -(-n // size))
        placed = lambda d: d.join(F.broadcast(spread), "len").withColumn("block", (F.lit(gen * 10_000_000) + F.col("first") + F.pmod(F.xxhash64("id"), "parts")).cast("int"))
        placed(lens).select("id", "len", "block").write.mode("overwrite").parquet(self._at(gen, "docs"))
        dealt = placed(said).drop("first", "parts").repartition(blocks, "block")
        if "said" in said.columns:
            each = dealt.where("len > 0").select("block", "id", "len", F.explode(F.split("said", " ")).alias("term"))
            dealt = each.groupBy("block", "id", "len", "term").agg(F.count(F.lit(1)).cast("int").alias("tf"))
        entry = F.array_sort(F.collect_list(F.struct("id", "tf", "len")))  # of one block
        rows = dealt.groupBy("block", "term").agg(
            F.count(F.lit(1)).alias("n"), F.max("tf").alias("tf_most"), F.min("tf").alias("tf_least"), F.min("len").alias("len_least"), F.max("len").alias("len_most"), entry.alias("entries")
        )
        rows = rows.select("term", "block", "n", "tf_most", "tf_least", "len_least", "len_most", "entries", (F.crc32(F.col("term").cast("binary")) % buckets).cast("int").alias("bucket"))
        tasks = buckets * -(-blocks // TOGETHER)
        rows = rows.repartition(tasks, "bucket", F.floor(F.col("block") / TOGETHER)).sortWithinPartitions("bucket", "term", "block")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(self._at(gen, "postings"))
        if gone is not None:
            gone.select("id").union(ids).distinct().write.mode("overwrite").parquet(self._at(gen, "gone"))
        for what in ("said", "lens"):
            folders.delete(self.spark, self._at(gen, what))
        line = self.spark.createDataFrame([(gen, base, buckets, gone is not None, ids.schema["id"].dataType.simpleString())], "gen int, base int, buckets int, gone boolean, id_type string")
        line.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")  # from here on it counts

    def update(self, rows: DataFrame, gone: DataFrame, id_col: str, fields: tuple[str, ...]) -> None:
        """A generation in which ``rows`` are new or replace what their ids had, and the ids ``gone`` (``id``) are no more."""
        known = self.manifest()
        last = known[-1]
        gen = last["gen"] + 1
        self._add(gen, last["base"], *self._written(gen, rows, id_col, fields), gone, last["buckets"])

    def compact(self) -> None:
        """All that is live as one generation; the earlier ones no longer count."""
        last = self.manifest()[-1]
        self._add(last["gen"] + 1, last["gen"] + 1, self.docs(), self.entries(), None, last["buckets"])

    def _later_gone(self, known: list[dict], gen: int) -> DataFrame | None:
        parts = [self._read(r, "gone") for r in known if r["gen"] > gen and r["gone"]]
        return reduce(DataFrame.union, parts).distinct() if parts else None

    def _live(self, what: str, pick) -> DataFrame:
        """Rows of all generations, made by ``pick`` from their tables, without the ids that later ones replace."""
        known, parts = self.manifest(), []
        for r in known:
            part = pick(self._read(r, what), r)
            gone = self._later_gone(known, r["gen"])
            if gone is not None and gone.count() <= BROADCAST_IDS:  # else every entry would be dealt out by id
                gone = F.broadcast(gone)
            parts.append(part if gone is None else part.join(gone, "id", "left_anti"))
        return reduce(DataFrame.unionByName, parts)

    def docs(self) -> DataFrame:
        """``id, len`` of all live documents."""
        return self._live("docs", lambda d, r: d.select("id", "len"))

    def entries(self, terms: list[str] | None = None) -> DataFrame:
        """``id, term, tf, len`` of all live documents, of the given terms only."""
        each = lambda d, r: self._of(d, r, terms).select("term", F.explode("entries").alias("e")).select("e.id", "term", "e.tf", "e.len")
        return self._live("postings", each)

    @staticmethod
    def _of(postings: DataFrame, line: dict, terms: list[str] | None) -> DataFrame:
        """The rows of the terms: their buckets only are read, their row groups found by statistics."""
        if terms is None:
            return postings
        buckets = sorted({zlib.crc32(t.encode()) % line["buckets"] for t in terms})
        return postings.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))

    # ---- queries ----------------------------------------------------------

    def match(self, terms: list[str], most: int | None = None, only: DataFrame | None = None) -> DataFrame | None:
        """``id, score`` of the ``most`` best documents by BM25 that have any of the terms; None if none has.

        ``only`` (``id``) restricts the answer, not the statistics. Ties go to
        the smaller id.
        """
        terms = list(dict.fromkeys(fold(t) for t in terms))
        known = self.manifest()
        if not terms or not known:
            return None
        stats = self.docs().agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean")).first()
        plain = len(known) == 1 and only is None  # the extremes hold for live documents
        if plain:
            postings = self._of(self._read(known[0], "postings"), known[0], terms)
            heads = postings.select("term", "block", "n", "tf_most", "tf_least", "len_least", "len_most")
            found = heads.groupBy("term").agg(F.sum("n").alias("df"))
        else:
            found = self.entries(terms).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        df = {r["term"]: r["df"] for r in found.collect()}  # a row for each term
        if not df:
            return None
        n, mean = stats["n"], stats["mean"]

        def part(t: str, tf: Column, size: Column) -> Column:
            f = tf.cast("bigint")
            return F.log(F.lit(1 + (n - df[t] + 0.5) / (df[t] + 0.5))) * f * (K1 + 1) / (f + K1 * (1 - B + B * size / F.lit(mean)))

        some = [t for t in terms if t in df]
        if plain:
            if most and sum(df.values()) > most:
                postings = self._reachable(postings, heads, some, part, most)
            rows = postings.select("term", F.explode("entries").alias("e")).select("e.id", "term", "e.tf", "e.len")
        else:
            rows = self.entries(some)
            rows = rows if only is None else rows.join(only, "id", "left_semi")
        # a column for each term, so that parts are always added in the same order
        wide = rows.groupBy("id").agg(F.max("len").alias("len"), *[F.max(F.when(F.col("term") == t, F.col("tf"))).alias(f"tf{i}") for i, t in enumerate(some)])
        score = reduce(Column.__add__, [part(t, F.coalesce(f"tf{i}", F.lit(0)), F.col("len")) for i, t in enumerate(some)])
        scored = wide.select("id", score.alias("score"))
        return scored.orderBy(F.desc("score"), "id").limit(most) if most else scored

    @staticmethod
    def _reachable(postings: DataFrame, heads: DataFrame, terms: list[str], part, most: int) -> DataFrame:
        """The posting rows of blocks that may hold one of the ``most`` best."""
        by_term = lambda tf, size: reduce(lambda x, t: x.when(F.col("term") == t, part(t, F.col(tf), F.col(size))), terms, F.when(F.lit(False), F.lit(0.0)))
        heads = heads.withColumns({"high": by_term("tf_most", "len_least"), "low": by_term("tf_least", "len_most")})
        order = Window.partitionBy("term").orderBy(F.desc("low")).rowsBetween(Window.unboundedPreceding, 0)
        reached = heads.withColumn("docs", F.sum("n").over(order)).where(F.col("docs") >= most).agg(F.max("low").alias("low")).first()["low"]
        if reached is None:
            return postings
        blocks = heads.groupBy("block").agg(F.sum("high").alias("high")).where(F.col("high") >= reached * (1 - 1e-9)).select("block")
        few = blocks.count() <= BROADCAST_BLOCKS
        return postings.join(F.broadcast(blocks) if few else blocks, "block", "left_semi")
