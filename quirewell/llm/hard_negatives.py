"""Hard negatives by inner product, found by length and coordinate pruning.

Vectors lie in buckets of like length, longest first; a bucket holds, for every
coordinate, its vectors sorted by that coordinate of their directions. A
search has a score to reach. Over a bucket that is a cosine to reach, as no
vector is longer than the bucket's longest: above 1 the bucket is passed over,
otherwise each focus coordinate of the anchor (where its direction is largest)
allows a range of values only. The lists' ranges are intersected, and what is
left is verified exactly, in integers; the best found so far raise the score to
reach.

A first search gives an anchor's positives, a second one the best rows of other
labels whose score lies in a range of each positive's score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, salted_join, work_dir

#: Vectors of a bucket and of a shard (the buckets that one task searches); focus coordinates of an anchor.
BUCKET, SHARD, FOCUS = 2048, 32768, 4
#: Anchors of a block, and blocks that a shard is decoded for at once.
TOGETHER, BLOCKS = 512, 32
#: Slack of lengths, cosines and values in double precision; what is verified is exact.
SLACK = 1e-9


class Bucket:
    """Vectors (whole numbers) with ids and labels, and the sorted lists of their directions' coordinates."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, order: np.ndarray | None = None) -> None:
        self.ids, self.labels, self.x = ids, labels, x
        plain = x.astype(np.float64)
        length = np.sqrt(np.einsum("ij,ij->i", plain, plain))
        self.longest = float(length.max(initial=0))
        self.unit = plain / np.where(length > 0, length, 1)[:, None]
        self.order = np.argsort(self.unit, axis=0, kind="stable").T.astype(np.int16) if order is None else order
        self.sorted = np.take_along_axis(self.unit.T, self.order.astype(np.int64), axis=1)
        self.largest = int(np.abs(x).max(initial=0))
        self.plain = plain

    def candidates(self, q: np.ndarray, size: float, focus: np.ndarray, least: float) -> np.ndarray | None:
        """Places of all vectors whose product with ``q * size`` (q a direction) can reach ``least``; None if that may be any."""
        if least <= 0:
            return None
        reach = size * self.longest
        if least > reach * (1 + SLACK):
            return np.zeros(0, np.int64)
        turn = math.acos(min(1.0, least / reach))
        ranges = []
        for f in focus.tolist():
            angle = math.acos(max(-1.0, min(1.0, q[f])))
            low, high = math.cos(min(math.pi, angle + turn)) - SLACK, math.cos(max(0.0, angle - turn)) + SLACK
            a, b = np.searchsorted(self.sorted[f], (low, high), side="left")
            ranges.append((int(b - a), f, int(a), int(b), low, high))
        ranges.sort()
        n, f, a, b, _, _ = ranges[0]
        if n == len(self.ids):
            return None
        found = self.order[f, a:b].astype(np.int64)
        for _, f, _, _, low, high in ranges[1:]:
            value = self.unit[found, f]
            found = found[(value >= low) & (value <= high)]
        return found

    def scores(self, q: np.ndarray, found: np.ndarray | None) -> np.ndarray:
        """Exact inner products of the vectors at ``found`` (None: all) with ``q``."""
        if self.largest * int(np.abs(q).max(initial=0)) * len(q) < 1 << 53:  # exact in double precision, too
            return ((self.plain if found is None else self.plain[found]) @ q.astype(np.float64)).astype(np.int64)
        return (self.x if found is None else self.x[found]) @ q


class Ask:
    """The k best rows with a score from ``low`` to ``high``, ties by smaller id."""

    def __init__(self, key: int, low: int, high: int, k: int) -> None:
        self.key, self.low, self.high, self.k = key, low, high, k
        self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        ok = (score >= self.low) & (score <= self.high)
        if ok.any():
            score, ids = np.append(self.score, score[ok]), np.append(self.id, ids[ok])
            best = np.lexsort((ids, -score))[: self.k]
            self.score, self.id = score[best], ids[best]
            if len(best) == self.k:
                self.low = max(self.low, int(self.score[-1]))


def search_bucket(bucket: Bucket, q: np.ndarray, unit: np.ndarray, size: float, focus: np.ndarray, label: int, same: bool, asks: list[Ask]) -> None:
    """Bring the bucket's rows of the same label, or of the others, into ``asks``."""
    least = min(a.low for a in asks)
    found = bucket.candidates(unit, size, focus, float(least))
    labels = bucket.labels if found is None else bucket.labels[found]
    right = np.flatnonzero((labels == label) == same)
    if not len(right):
        return
    if len(right) < len(labels) or found is not None:
        found = right if found is None else found[right]
    score = bucket.scores(q, found)
    ids = bucket.ids if found is None else bucket.ids[found]
    for a in asks:
        a.add(score, ids)


INDEX = "shard int, bucket int, ids binary, labels binary, vectors binary, lists binary"


def build_index(rows: DataFrame, shards: int) -> DataFrame:
    """A row for each bucket of ``vec_id, label, v``; shard 0 has the longest vectors. A sort by length, no vector leaves its shard's task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [f for f in frames if len(f)]
        if not held:
            return
        f = pd.concat(held).sort_values(["square", "vec_id"], ascending=[False, True], ignore_index=True)
        x = np.stack([np.asarray(v, np.int64) for v in f["v"]])
        for i, at in enumerate(range(0, len(f), BUCKET)):
            part = slice(at, at + BUCKET)
            b = Bucket(f["vec_id"].to_numpy()[part], f["label"].to_numpy()[part], x[part])
            yield pd.DataFrame({"shard": [int(f["shard"][0])], "bucket": [i], "ids": [b.ids.tobytes()], "labels": [b.labels.tobytes()], "vectors": [b.x.tobytes()], "lists": [b.order.tobytes()]})

    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    dealt = rows.select("vec_id", "label", "v", square.alias("square")).repartitionByRange(shards, F.desc("square"), "vec_id")
    return dealt.withColumn("shard", F.spark_partition_id()).mapInPandas(run, INDEX)


ASKS = "array<struct<key:bigint,low:bigint,high:bigint>>"


def search_index(index: DataFrame, shards: range, asked: DataFrame, k: int, same: bool) -> DataFrame:
    """``node, key, vec_id, score`` of ``node, label, v, asks``: for each ask the k best rows of the ``shards`` of ``index``.

    ``same``: of the node's label, else of all others. Anchors are dealt in
    blocks to every shard; a shard comes before its blocks, so that it is
    decoded once for BLOCKS of them.
    """
    index = index.where(F.col("shard").between(shards.start, shards.stop - 1))
    blocks = max(1, -(-asked.count() // TOGETHER))
    groups = -(-blocks // BLOCKS)
    packed = asked.withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(blocks)).cast("int")).groupBy("block").agg(F.collect_list(F.struct("node", "label", "v", "asks")).alias("q"))
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    q_type = f"array<struct<node:bigint,label:bigint,v:array<bigint>,asks:{ASKS}>>"
    graphs = index.select("shard", every.alias("g"), "bucket", "ids", "labels", "vectors", "lists", F.lit(None).cast(q_type).alias("q"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("bucket", "int"), ("ids", "binary"), ("labels", "binary"), ("vectors", "binary"), ("lists", "binary"))]
    questions = packed.select(F.explode(F.sequence(F.lit(shards.start), F.lit(shards.stop - 1))).alias("shard"), (F.col("block") % groups).alias("g"), *nothing, "q")
    dealt = graphs.union(questions).repartition(max(1, len(shards) * groups), "shard", "g").sortWithinPartitions("shard", "g", F.col("q").isNotNull(), "bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets: list[Bucket] = []
        answered = True
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                if not row["q"].is_valid:
                    if answered:
                        buckets, answered = [], False
                    ids, labels = (np.frombuffer(row[c].as_py(), np.int64) for c in ("ids", "labels"))
                    x = np.frombuffer(row["vectors"].as_py(), np.int64).reshape(len(ids), -1)
                    buckets.append(Bucket(ids, labels, x, np.frombuffer(row["lists"].as_py(), np.int16).reshape(-1, len(ids))))
                    continue
                answered = True
                out: list[tuple[int, Ask]] = []
                for one in row["q"].as_py():
                    q = np.asarray(one["v"], np.int64)
                    plain = q.astype(np.float64)
                    size = math.sqrt(float(plain @ plain))
                    unit = plain / size if size else plain
                    focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
                    asks = [Ask(a["key"], a["low"], a["high"], k) for a in one["asks"]]
                    for b in buckets:
                        search_bucket(b, q, unit, size, focus, one["label"], same, asks)
                    out += [(one["node"], a) for a in asks if len(a.id)]
                if out:
                    rows = [np.array([n for n, a in out for _ in a.id]), np.array([a.key for _, a in out for _ in a.id]), np.concatenate([a.id for _, a in out]), np.concatenate([a.score for _, a in out])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["node", "key", "vec_id", "score"])

    found = dealt.mapInArrow(run, "node bigint, key bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("node", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k)


def mine(rows: DataFrame, anchor_if: str, positives: int = 5, negatives: int = 3, low_pct: int = 50, high_pct: int = 95, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become floor(scale * x); scores are integer inner products.
    Anchors are the rows that ``anchor_if`` (SQL on ``vec_id``) picks. An
    anchor's positives are its first ``positives`` other rows of its label, by
    score, ties by smaller id. For each of them: the first ``negatives`` rows of
    other labels whose score is from low_pct to high_pct per cent of the positive's.

    Rows with a null id, label or vector, an empty vector, or a null or
    non-finite component take no part, nor do those of another dimension than
    most have, nor those with a component so large that products leave 64
    bits (about 6 million for 64 components at scale 256). A zero vector has score 0 with all. Equal rows of
    one id count once; rows of one id are never each other's positives. Anchors
    without positives or negatives have no rows; an empty table gives an empty
    result. Other columns are not read.
    """
    spark = rows.sparkSession
    home = work_dir(spark)
    x = F.col(vector_col).cast("array<double>")
    rows = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"), x.alias("x"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND size(x) > 0 AND forall(x, y -> y IS NOT NULL AND NOT isnan(y) AND abs(y) < double('infinity'))")
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    d = sizes[0]["d"]
    most = math.isqrt((1 << 62) // d)
    rows = rows.where((F.size("x") == d) & F.forall("x", lambda y: F.abs(y * scale) < most))
    rows = keep(rows.select("vec_id", "label", F.transform("x", lambda y: F.floor(y * scale).cast("bigint")).alias("v")), f"{home}/rows")
    # of rows of equal label and vector only the first few can be among anyone's best
    few = max(positives + 1, negatives)
    order = Window.partitionBy("label", "v").orderBy("vec_id")
    kept = keep(rows.distinct().withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= few).drop("rn"), f"{home}/kept")
    shards = max(1, -(-kept.count() // SHARD))
    index = keep(build_index(kept, shards), f"{home}/index")

    # anchors of equal label and vector have the same answers but for themselves: one of them asks
    anchors = rows.where(anchor_if).distinct()
    nodes = keep(anchors.groupBy("label", "v").agg(F.min("vec_id").alias("node")), f"{home}/nodes")
    ask = lambda low, high: F.array(F.struct(F.lit(0).cast("bigint").alias("key"), low.cast("bigint").alias("low"), high.cast("bigint").alias("high")))
    least, top = F.lit(-(1 << 63) + 1), F.lit((1 << 63) - 1)
    near = search_index(index, range(1), nodes.withColumn("asks", ask(least, top)), positives + 1, True)
    if shards > 1:  # the longest vectors first: what they give is to be beaten by the others
        near = keep(near, f"{home}/near-0")
        reached = near.where(F.col("rn") == positives + 1).select("node", F.col("score").alias("reached"))
        asked = nodes.join(reached, "node", "left").withColumn("asks", ask(F.coalesce("reached", least), top)).drop("reached")
        near = near.unionByName(search_index(index, range(1, shards), asked, positives + 1, True))
    pair = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "vec_id")))
    found = near.groupBy("node").agg(F.slice(pair, 1, positives + 1).alias("near"))  # at most two lists of a few
    found = keep(found, f"{home}/near")

    # per cent of whole numbers, exactly and within 64 bits
    limits = f"named_struct('key', s, 'low', s div 100 * {low_pct} + (s % 100 * {low_pct} + 99) div 100, 'high', s div 100 * {high_pct} + s % 100 * {high_pct} div 100)"
    asks = F.expr(f"transform(array_distinct(transform(filter(near, y -> y.down <= 0), y -> -y.down)), s -> {limits})")
    asked = nodes.join(found.select("node", asks.alias("asks")), "node").where("size(asks) > 0")
    against = search_index(index, range(shards), asked, negatives, False)
    against = against.groupBy("node", "key").agg(F.sort_array(F.collect_list(F.struct("rn", "vec_id", "score"))).alias("of"))
    against = against.groupBy("node").agg(F.collect_list(F.struct("key", "of")).alias("against"))  # a list for each of a few scores
    answers = keep(nodes.join(found.join(against, "node"), "node").drop("node"), f"{home}/answers")
    each = salted_join(anchors, answers, ["label", "v"], "vec_id")
    other = F.slice(F.filter("near", lambda y: y["vec_id"] != F.col("vec_id")), 1, positives)
    each = each.select(F.col("vec_id").alias("anchor_id"), F.explode(other).alias("p"), "against")
    each = each.select("anchor_id", F.col("p.vec_id").alias("positive_id"), (-F.col("p.down")).alias("positive_score"), "against")
    of_it = F.get(F.filter("against", lambda y: y["key"] == F.col("positive_score")), 0)["of"]  # null: none
    each = each.withColumn("n", F.explode(of_it))
    return each.select("anchor_id", "positive_id", F.col("n.rn").cast("int").alias("rank"), F.col("n.vec_id").alias("negative_id"), "positive_score", F.col("n.score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return mine(rows.withColumn("label", F.expr("IF(vec_id % 7 = 0, (label + 1) % 10, label)")), "vec_id % 50 = 0")


OP13_SQL = """
WITH r AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
             row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
