"""Nearest neighbours by inner product over robust-pruned directed graphs.

Equal vectors are one node, so copies cost nothing. Nodes are dealt into shards
of bounded size; each shard's graph is built in one task: greedy searches
propose neighbours, relaxed distance pruning keeps diverse edges. The index is
a table with a row for each shard. Every query runs a beam search in each
shard, in blocks; the shards' best are merged and scored exactly.

Largest inner product is nearest distance after one more coordinate makes all
vectors equally long (queries get a zero there).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, work_dir

#: Nodes of a shard, out-edges of a node, beam of building and of searching, and how far pruning is relaxed.
SHARD, DEGREE, BUILD_BEAM, SEARCH_BEAM, RELAXED = 8192, 24, 48, 96, 1.2
#: Points or queries handled together, nodes expanded at once.
TOGETHER, WIDE = 256, 4
#: Blocks of queries that a shard is decoded for at once.
BLOCKS = 32


class Graph:
    """Vectors (equally long), out-edges (-1: none) and the place where searches start."""

    def __init__(self, x: np.ndarray, edges: np.ndarray, start: int) -> None:
        self.x, self.edges, self.start = x, edges, start
        self.square = np.einsum("ij,ij->i", x, x)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest nodes found for each query, nearest first (-1 where there are fewer), and their distances."""
        b, n = len(q), len(self.x)
        beam = min(beam, n)
        ids = np.full((b, beam), -1)
        far = np.full((b, beam), np.inf, dtype=np.float32)
        done = np.ones((b, beam), dtype=bool)
        seen = np.zeros((b, n), dtype=bool)
        ids[:, 0], done[:, 0], seen[:, self.start] = self.start, False, True
        far[:, 0] = self.square[self.start] - 2 * (q @ self.x[self.start])
        rows = np.arange(b)
        while len(rows):
            open_ = ~done[rows]
            order = np.argsort(~open_, axis=1, kind="stable")[:, :WIDE]  # the nearest that are open
            picked = np.where(np.take_along_axis(open_, order, 1), np.take_along_axis(ids[rows], order, 1), -1)
            done[rows[:, None], order] = True
            near = np.where(picked[:, :, None] >= 0, self.edges[picked], -1).reshape(len(rows), -1)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            fresh = (near >= 0) & ~seen[rows[:, None], near]
            seen[rows[:, None], np.where(fresh, near, self.start)] = True
            d = self.square[near] - 2 * np.einsum("bnd,bd->bn", self.x[near], q[rows])
            d[~fresh] = np.inf
            all_ids, all_far = np.concatenate([ids[rows], near], 1), np.concatenate([far[rows], d], 1)
            all_done = np.concatenate([done[rows], ~fresh], 1)
            best = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
            ids[rows], far[rows], done[rows] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_far, best, 1), np.take_along_axis(all_done, best, 1)
            done[rows] |= np.isinf(far[rows])
            rows = rows[~done[rows].all(axis=1)]
        return np.where(np.isinf(far), -1, ids), far


def prune(x: np.ndarray, points: np.ndarray, pool: np.ndarray, degree: int, relaxed: float) -> np.ndarray:
    """Diverse neighbours of each point out of its pool (-1: none).

    The nearest of the pool is kept; what is nearer to it than to the point, by
    the factor ``relaxed``, goes; and so on.
    """
    pool = np.sort(pool, axis=1)
    pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
    pool[pool == points[:, None]] = -1
    vectors = x[pool]
    own = vectors - x[points][:, None, :]
    far = np.einsum("bnd,bnd->bn", own, own)
    far[pool < 0] = np.inf
    alive = pool >= 0
    out = np.full((len(points), degree), -1, dtype=np.int32)
    rows = np.arange(len(points))
    for k in range(degree):
        at = np.where(alive, far, np.inf).argmin(axis=1)
        ok = alive[rows, at]
        if not ok.any():
            break
        out[ok, k] = pool[rows, at][ok]
        away = vectors - vectors[rows, at][:, None, :]
        alive &= relaxed * relaxed * np.einsum("bnd,bnd->bn", away, away) > far
        alive[rows, at] = False
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, seed: int = 5) -> Graph:
    """A graph over the vectors: random edges first, then two rounds of search and pruning, the second relaxed."""
    n, rng = len(x), np.random.default_rng(seed)
    room = 2 * degree  # back-edges gather up to here before they are pruned
    edges = np.full((n, room), -1, dtype=np.int32)
    if n > 1:
        edges[:, :degree] = rng.integers(0, n - 1, (n, degree))
        edges[:, :degree] += edges[:, :degree] >= np.arange(n)[:, None]
    middle = x.mean(axis=0)
    graph = Graph(x, edges, int(((x - middle) ** 2).sum(axis=1).argmin()))
    for relaxed in (1.0, RELAXED):
        for points in np.array_split(rng.permutation(n), max(1, n // TOGETHER)):
            found, _ = graph.search(x[points], beam)
            kept = prune(x, points, np.concatenate([found, edges[points]], 1), degree, relaxed)
            edges[points] = -1
            edges[points, :degree] = kept
            # back-edges: fill free places, prune where there is no room
            to, origin = kept.ravel(), np.repeat(points, degree)
            origin, to = origin[to >= 0], to[to >= 0]
            known = (edges[to] == origin[:, None]).any(axis=1)
            order = np.argsort(to[~known], kind="stable")
            to, origin = to[~known][order], origin[~known][order]
            targets, first, count = np.unique(to, return_index=True, return_counts=True)
            used = (edges[targets] >= 0).sum(axis=1)
            place = np.repeat(used, count) + np.arange(len(to)) - np.repeat(first, count)
            fits = np.repeat(used + count <= room, count)
            edges[to[fits], place[fits]] = origin[fits]
            full = np.flatnonzero(used + count > room)
            for some in np.array_split(full, max(1, len(full) // TOGETHER)) if len(full) else []:
                pool = np.full((len(some), room + int(count[some].max())), -1)
                pool[:, :room] = edges[targets[some]]
                for i, t in enumerate(some):
                    pool[i, room : room + count[t]] = origin[first[t] : first[t] + count[t]]
                edges[targets[some]] = -1
                edges[targets[some], :degree] = prune(x, targets[some], pool, degree, relaxed)
    return graph


def _level(x: np.ndarray) -> np.ndarray:
    """One more coordinate that makes all rows equally long."""
    square = np.einsum("ij,ij->i", x, x)
    return np.column_stack([x, np.sqrt(np.maximum(square.max() - square, 0))]).astype(np.float32)


def build_index(nodes: DataFrame, shards: int) -> DataFrame:
    """``shard, ids, vectors, edges, room, start`` of ``node, v``: one row for each shard."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("node", ignore_index=True)
        x = np.stack([np.asarray(v, dtype=np.float64) for v in f["v"]])
        graph = build(_level(x))
        return pd.DataFrame({"shard": [int(f["shard"][0])], "ids": [f["node"].to_numpy().tobytes()], "vectors": [x.tobytes()], "edges": [graph.edges.tobytes()], "room": [graph.edges.shape[1]], "start": [graph.start]})

    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")).repartitionByRange(shards, "shard")  # a task for each
    return dealt.groupBy("shard").applyInPandas(run, "shard int, ids binary, vectors binary, edges binary, room int, start int")


def search_index(index: DataFrame, queries: DataFrame, shards: int, k: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """``query, node, score`` of ``node, v``: the k best of each shard for every query, scored in double precision."""
    blocks = max(1, -(-queries.count() // 512))
    block = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(blocks)).cast("int")
    packed = queries.withColumn("block", block).groupBy("block").agg(F.collect_list(F.struct("node", "v")).alias("q"))  # about 512 each
    groups = -(-blocks // BLOCKS)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    graphs = index.select("shard", each(groups).alias("g"), "ids", "vectors", "edges", "start", F.lit(None).cast("array<struct<node:bigint,v:array<double>>>").alias("q"))
    asked = packed.select(each(shards).alias("shard"), (F.col("block") % groups).alias("g"), *(F.lit(None).cast(t).alias(c) for c, t in (("ids", "binary"), ("vectors", "binary"), ("edges", "binary"), ("start", "bigint"))), "q")
    # a shard comes before the blocks of queries that search it, so that it is decoded once for BLOCKS of them
    dealt = graphs.withColumn("start", F.col("start").cast("bigint")).union(asked).repartitionByRange(shards * groups, "shard", "g").sortWithinPartitions("shard", "g", F.col("q").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                if not row["q"].is_valid:
                    ids, x = np.frombuffer(row["ids"].as_py(), np.int64), np.frombuffer(row["vectors"].as_py(), np.float64)
                    x = x.reshape(len(ids), -1)
                    graph = Graph(_level(x), np.frombuffer(row["edges"].as_py(), np.int32).reshape(len(ids), -1), row["start"].as_py())
                    continue
                q = row["q"].values
                name, v = q.field("node").to_numpy(), np.stack([np.asarray(y, np.float64) for y in q.field("v").to_pylist()])
                out: list[tuple[np.ndarray, ...]] = []
                for s in range(0, len(name), TOGETHER):
                    part = v[s : s + TOGETHER]
                    found, _ = graph.search(np.column_stack([part, np.zeros(len(part))]).astype(np.float32), max(beam, k))
                    score = np.einsum("bnd,bd->bn", x[found], part)
                    score[found < 0] = -np.inf
                    best = np.lexsort((ids[found], -score), axis=1)[:, :k]
                    score, found = np.take_along_axis(score, best, 1), np.take_along_axis(found, best, 1)
                    ok = (found >= 0).ravel()
                    out.append((np.repeat(name[s : s + TOGETHER], found.shape[1])[ok], ids[found].ravel()[ok], score.ravel()[ok]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query", "node", "score"])

    return dealt.mapInArrow(run, "query bigint, node bigint, score double")


def nearest(rows: DataFrame, query_if: str, k: int = 20, shard_size: int = SHARD, beam: int = SEARCH_BEAM, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``query_if`` (SQL on ``vec_id``) picks, its k nearest other rows.

    Ranks start at 1; ties go to the smaller id. Vectors that are null, empty or
    zero, or hold a null or non-finite component, take no part, nor do those of
    another dimension than most have, nor rows with a null id. A repeated id
    counts once. With fewer than k candidates all are returned. An empty table
    gives an empty result. Other columns are not read.
    """
    spark = rows.sparkSession
    home = work_dir(spark)
    v = F.col(vector_col).cast("array<double>")
    rows = rows.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    rows = rows.where("forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    rows = rows.where(F.size("v") == sizes[0]["d"])
    # equal vectors are one node, named by their smallest id; k + 1 of their ids can matter
    order = Window.partitionBy("v").orderBy("vec_id")
    members = keep(rows.distinct().withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k + 1), f"{home}/members")
    nodes = keep(members.where("rn = 1").select(F.col("vec_id").alias("node"), "v"), f"{home}/nodes")
    wanted = rows.where(query_if).select("vec_id", "v").distinct().join(nodes, "v").select("vec_id", "node")
    wanted = keep(wanted, f"{home}/wanted")
    shards = max(1, -(-nodes.count() // shard_size))
    index = keep(build_index(nodes, shards), f"{home}/index")
    asked = nodes.join(wanted.select("node").distinct(), "node", "left_semi")
    found = search_index(index, asked, shards, k + 1, beam)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    found = found.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k + 1)
    ids = members.join(nodes, "v").groupBy("node").agg(F.collect_list("vec_id").alias("ids"))  # k + 1 at most
    listed = found.join(ids, "node").select("query", "score", F.explode("ids").alias("vec_id"))
    top = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    listed = listed.withColumn("rn", F.row_number().over(top)).where(F.col("rn") <= k + 1)
    lists = keep(listed.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rn", "vec_id", "score"))).alias("near")), f"{home}/lists")
    other = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("own")), 1, k)
    out = wanted.select(F.col("vec_id").alias("own"), F.col("node").alias("query")).join(lists, "query").select("own", F.posexplode(other).alias("at", "x"))
    return out.select(F.col("own").alias("query_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 20 = 0")
