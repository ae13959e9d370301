"""Ranked lexical search by MaxScore with joint maxima of term pairs.

Documents are read once: each gives its number of terms and the frequencies of
the terms that are asked for. Statistics over all documents give integer
weights. Documents are then indexed in blocks: a sorted posting list for each
term with its greatest impact, and, for pairs of terms that stand together in a
query, the intersection of their lists with the greatest joint impact. A query
takes its terms from the heaviest down; the bound of those still to come is the
least that independent maxima and pairs give (a document that holds both terms of
a pair has at most the joint maximum, any other at most the greater of the two).
Blocks whose bound is below the tenth best score are passed over, only the heavy
terms' lists bring in documents, and these are dropped once they can't catch up.

All scores and bounds are 64-bit integers, so nothing is lost to rounding.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, pieces, work_dir

#: Documents of an index block, and postings after which it is closed earlier.
BLOCK, BLOCK_POSTINGS = 4096, 1 << 20
#: Terms of a query that are paired: this far apart by weight.
PAIR_REACH = 2
#: Bytes of the terms of queries that are answered in one pass over the documents; more queries take more passes.
ASKED_BYTES = 16 << 20

#: Letters and digits of ASCII and all that is no ASCII stay, A-Z as a-z; the rest becomes a blank.
_TERM = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """All terms of a text, in order, with repeats."""
    return text.encode().translate(_TERM).split()


def query_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, terms``: the distinct terms of each item, sorted; rows of one id are one item, items without terms are left out."""
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted({t.decode() for t in terms_of(x or "")}) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(terms, pa.list_(pa.string()))], ["item_id", "terms"])

    each = items.selectExpr(f"`{id_col}` AS item_id", f"`{text_col}` AS text").mapInArrow(run, f"item_id {kind}, terms array<string>")
    return each.groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("terms")))).alias("terms")).where("size(terms) > 0")


def count_terms(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """``doc_id, n, term, tf`` of ``doc_id, text``: number of terms, and those of the vocabulary (by place in it) with their frequencies.

    Documents without any term are left out. The vocabulary is bounded by ASKED_BYTES and goes to each worker once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {t: i for i, t in enumerate(shared.value)}
        for whole in batches:
            for batch in pieces(whole, "text"):
                some, n, term, tf = [], [], [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    words = terms_of(text) if text else ()
                    if words:
                        found = Counter(map(at.get, words))
                        found.pop(None, None)
                        some.append(i)
                        n.append(len(words))
                        term.append(list(found))
                        tf.append(list(found.values()))
                ids = batch.column("doc_id").take(pa.array(some, pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(term, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))], ["doc_id", "n", "term", "tf"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, term array<int>, tf array<int>")


class Queries:
    """Items with their terms (places in the vocabulary) from the heaviest down, and the pairs of terms whose joint maxima an index holds."""

    def __init__(self, ids: list, terms: list[np.ndarray], weight: np.ndarray) -> None:
        self.ids, self.weight = ids, weight
        self.terms = [t[np.lexsort((t, -weight[t]))] for t in terms]
        size = len(weight)
        made = [np.minimum(t[:-g], t[g:]) * size + np.maximum(t[:-g], t[g:]) for t in self.terms for g in range(1, PAIR_REACH + 1) if len(t) > g]
        self.pairs = np.unique(np.concatenate(made)) if made else np.zeros(0, np.int64)
        self.place = {p: i for i, p in enumerate(self.pairs.tolist())}
        self.size = size

    def pair(self, a: int, b: int) -> int:
        """Place of a pair among those held, -1 if it isn't."""
        return self.place.get(min(a, b) * self.size + max(a, b), -1)


def joint_maxima(pairs: np.ndarray, size: int, term: np.ndarray, start: np.ndarray, place: np.ndarray, impact: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (by place in ``pairs``) whose posting lists intersect, and the greatest sum of impacts in each intersection."""
    row = np.full(size, -1)
    row[term] = np.arange(len(term))
    first, second = row[pairs // size], row[pairs % size]
    both = np.flatnonzero((first >= 0) & (second >= 0))
    dense = np.zeros(docs, np.int64)
    held, best = [], []
    for part in np.split(both, np.flatnonzero(np.diff(first[both])) + 1) if len(both) else []:
        a, partners = first[part[0]], second[part]
        own = slice(start[a], start[a + 1])
        dense[place[own]] = impact[own] + 1  # 0: not in the list
        many = start[partners + 1] - start[partners]
        ends = np.cumsum(many)
        at = np.repeat(start[partners] - (ends - many), many) + np.arange(ends[-1])
        other = dense[place[at]]
        top = np.maximum.reduceat(np.where(other > 0, other - 1 + impact[at], -1), ends - many)
        held.append(part[top >= 0])
        best.append(top[top >= 0])
        dense[place[own]] = 0
    none = np.zeros(0, np.int64)
    return (np.concatenate(held), np.concatenate(best)) if held else (none, none)


INDEX = "ids array<bigint>, term array<int>, start array<int>, place binary, impact binary, pair array<int>, joint array<bigint>"


def build_index(counted: DataFrame, queries: Queries, n_docs: int, n_terms: int) -> DataFrame:
    """A row for each block of documents: ids, posting lists side by side (place in the block and impact) and joint maxima of pairs.

    The table is for the terms and pairs of ``queries``; a map over partitions of ``counted``.
    """
    shared = counted.sparkSession.sparkContext.broadcast((queries.weight, queries.pairs))

    def block(held: list[pa.RecordBatch], weight: np.ndarray, pairs: np.ndarray) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        lists = t.column("term").combine_chunks()
        many = np.diff(np.asarray(lists.offsets))
        term, tf = np.asarray(lists.flatten(), dtype=np.int64), np.asarray(t.column("tf").combine_chunks().flatten(), dtype=np.int64)
        place = np.repeat(np.arange(len(many)), many)
        m = 10 + 90 * t.column("n").to_numpy() * n_docs // n_terms
        impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[place]))
        order = np.lexsort((place, term))
        term, place, impact = term[order], place[order].astype(np.int32), impact[order]
        kinds, start = np.unique(term, return_index=True)
        start = np.append(start, len(term))
        pair, joint = joint_maxima(pairs, len(weight), kinds, start, place, impact, len(many))
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
        row = {"ids": (t.column("doc_id").to_pylist(), longs), "term": (kinds.tolist(), ints), "start": (start.tolist(), ints), "place": (place.tobytes(), pa.binary()), "impact": (impact.tobytes(), pa.binary()), "pair": (pair.tolist(), ints), "joint": (joint.tolist(), longs)}
        return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in row.values()], list(row))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, pairs = shared.value
        held, docs, postings = [], 0, 0
        for batch in batches:
            lists = batch.column("term")
            size = np.diff(np.asarray(lists.offsets))
            at = 0
            while at < batch.num_rows:
                room = BLOCK - docs
                sums = np.cumsum(size[at : at + room])
                take = max(1, int(np.searchsorted(sums, BLOCK_POSTINGS - postings, side="right")))
                take = min(take, len(sums))
                held.append(batch.slice(at, take))
                docs, postings, at = docs + take, postings + int(sums[take - 1]), at + take
                if docs >= BLOCK or postings >= BLOCK_POSTINGS or at < batch.num_rows:
                    yield block(held, weight, pairs)
                    held, docs, postings = [], 0, 0
        if held:
            yield block(held, weight, pairs)

    return counted.where("size(term) > 0").mapInArrow(run, INDEX)


def suffix_bounds(most: list[int], joint: list[int]) -> list[int]:
    """For each place, the most that the terms from there on can add up to.

    ``most`` are the terms' maxima; ``joint[i]`` bounds terms i and i + 1
    together (the sum of their maxima where nothing better is known). Terms are
    taken singly or as neighbours, whichever gives the least.
    """
    out = [0] * (len(most) + 2)
    for i in range(len(most) - 1, -1, -1):
        out[i] = most[i] + out[i + 1]
        if i + 1 < len(most) and (together := joint[i] + out[i + 2]) < out[i]:
            out[i] = together
    return out


class Best:
    """The k best documents of one item: highest score first, then smallest id, null ids last."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.score = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    @property
    def least(self) -> int:
        """A score below this one can't get in."""
        return max(1, int(self.score[-1])) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids, null = np.append(self.score, score), np.append(self.id, ids), np.append(self.null, null)
        best = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.id, self.null = score[best], ids[best], null[best]


class Block:
    """One row of the index."""

    def __init__(self, row: dict, terms: int, pairs: int) -> None:
        ids = row["ids"].values
        self.null = np.asarray(ids.is_null().to_numpy(zero_copy_only=False))
        self.ids = np.asarray(ids.fill_null(0))
        kinds, self.start = np.asarray(row["term"].values), np.asarray(row["start"].values)
        self.place, self.impact = np.frombuffer(row["place"].as_py(), np.int32), np.frombuffer(row["impact"].as_py(), np.int64)
        self.row = np.full(terms, -1)
        self.row[kinds] = np.arange(len(kinds))
        self.most = np.maximum.reduceat(self.impact, self.start[:-1]) if len(kinds) else np.zeros(0, np.int64)
        self.joint = np.zeros(pairs, np.int64)  # 0: no document holds both
        self.joint[np.asarray(row["pair"].values)] = np.asarray(row["joint"].values)
        self.sum = np.zeros(len(self.ids), np.int64)

    def search(self, queries: Queries, item: int, best: Best) -> None:
        """Bring the block's documents into ``best`` of one item."""
        rows = self.row[queries.terms[item]]
        here = rows >= 0
        rows, terms = rows[here], queries.terms[item][here].tolist()
        if not len(rows):
            return
        most = self.most[rows].tolist()
        joint = []
        for i in range(len(terms) - 1):
            a, b = most[i], most[i + 1]
            at = queries.pair(terms[i], terms[i + 1])
            joint.append(a + b if at < 0 else max(a, b, int(self.joint[at])))
        bound, least = suffix_bounds(most, joint), best.least
        if bound[0] < least:
            return
        heavy = next((i for i in range(len(rows)) if bound[i] < least), len(rows))
        total = self.sum
        seen = []
        for r in rows[:heavy].tolist():
            span = slice(self.start[r], self.start[r + 1])
            total[self.place[span]] += self.impact[span]
            seen.append(self.place[span])
        found = np.flatnonzero(total)
        score = total[found]
        total[found] = 0
        if len(found) >= best.k:  # what is certain by now
            least = max(least, int(np.partition(score, len(score) - best.k)[len(score) - best.k]))
        for i in range(heavy, len(rows)):
            stays = score + bound[i] >= least
            found, score = found[stays], score[stays]
            if not len(found):
                return
            r = rows[i]
            list_ = self.place[self.start[r] : self.start[r + 1]]
            at = np.searchsorted(list_, found)
            at[at == len(list_)] = 0
            score = score + np.where(list_[at] == found, self.impact[self.start[r] + at], 0)
        stays = score >= least
        if stays.any():
            found = found[stays]
            best.add(score[stays], self.ids[found], self.null[found])


def search_index(index: DataFrame, queries: Queries, k: int) -> DataFrame:
    """``item, doc_id, score``: for every partition of the index each item's k best documents (``item``: its place among the queries)."""
    shared = index.sparkSession.sparkContext.broadcast((queries.terms, queries.weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weight = shared.value
        asked = Queries(list(range(len(terms))), terms, weight)
        best = [Best(k) for _ in terms]
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block({c: batch.column(c)[i] for c in batch.schema.names}, asked.size, len(asked.pairs))
                for item in range(len(terms)):
                    block.search(asked, item, best[item])
        for item, b in enumerate(best):
            if len(b.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.score), item)), pa.array(b.id, mask=b.null), pa.array(b.score)], ["item", "doc_id", "score"])

    return index.mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's k best documents with a score above 0, best first.

    Equal scores go to the smaller doc_id, null ids last. Every row of ``docs``
    is a document, repeated ones too; null and blank texts have no terms and
    count nowhere. Rows of ``items`` with one id are one item with all their
    terms, each once; items without terms, or whose terms no document holds,
    have no rows. Empty tables give an empty result. Other columns are not read.
    Whole texts are read, once for every ASKED_BYTES of items' terms.
    """
    spark = docs.sparkSession
    home = work_dir(spark)
    asked = keep(query_terms(items, item_col, item_text), f"{home}/asked")
    size = asked.select(F.sum(F.expr("aggregate(terms, 0L, (s, x) -> s + octet_length(x) + 8)")).alias("b")).first()["b"] or 0
    passes = -(-size // ASKED_BYTES)
    rows = docs.selectExpr(f"CAST(`{id_col}` AS bigint) AS doc_id", f"`{text_col}` AS text")
    kind = items.schema[item_col].dataType
    found = None
    for p in range(passes):
        some = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).orderBy("item_id").collect()  # ASKED_BYTES or so
        vocabulary = sorted({t for r in some for t in r["terms"]})
        place = {t: i for i, t in enumerate(vocabulary)}
        counted = keep(count_terms(rows, [t.encode() for t in vocabulary]), f"{home}/counted-{p}")
        n_docs, n_terms = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs or not some:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        for r in counted.select(F.explode("term").alias("term")).groupBy("term").count().toLocalIterator():
            df[r["term"]] = r["count"]
        weight = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        queries = Queries([r["item_id"] for r in some], [np.array([place[t] for t in r["terms"]], np.int64) for r in some], weight)
        index = keep(build_index(counted, queries, n_docs, n_terms), f"{home}/index-{p}")
        names = spark.createDataFrame(list(enumerate(queries.ids)), f"item bigint, item_id {kind.simpleString()}")
        each = search_index(index, queries, k).join(F.broadcast(names), "item")  # as many names as this pass has items
        found = each if found is None else found.unionByName(each)
    if found is None:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id bigint, score bigint")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_lexical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return rank_documents(read("documents"), read("benchmark"))


_PARTS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH d AS (SELECT doc_id, {_PARTS} AS parts FROM documents WHERE text IS NOT NULL),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_PARTS}) AS term FROM benchmark)),
s AS (SELECT count(*) AS n_docs, sum(len(parts))::BIGINT AS n_terms FROM d WHERE len(parts) > 0),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(parts) AS n, unnest(parts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term, n_docs),
x AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM x WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""
