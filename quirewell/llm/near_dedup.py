"""Near-duplicate documents by bottom-k sketches of their word shingles.

One hash function orders all shingles; a document retains its k smallest. The
inverted lists of the retained values give the documents that overlap; the
sketch of the union of two documents estimates their Jaccard similarity, and
documents that pass are compared on their full sets.

Scale. Equal sets are one node. A value that many documents retain (a common
word pair) would make a long list, so each node is listed only under the rarest
of its retained values: if two sketches share at least t of k values, they
share one of their k - t + 1 rarest (prefix filter); t comes from the threshold
and is only missed with a chance of about 1e-8. Each list first links its
members to its smallest one, so a group of n copies makes n links. Members of a
list that are still in different components then meet in blocks of bounded
size, those of sizes too different not at all: on their sketches first, and on
their full sets only if the sketches left a partner.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, by_group, drop, keep, lean, mix, only_ids, pieces, raw, tail_share, windows, words_of, work_dir
from .components import components

#: Members of a block and bytes of their sets: a group of n costs n / BLOCK copies of each, and a task holds two blocks.
BLOCK, BLOCK_BYTES = 512, 4 << 20
#: Standard errors by which an estimate may fall short of the threshold.
SLACK = 6.0
#: Cells of a matrix of sketches that are handled at once.
CELLS = 1 << 19


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text: words lower-cased (A-Z); a text of fewer words is one shingle."""
    data, at = raw(batch.column("text"))
    words, first = words_of(data, at, lower=True)
    grams = windows(words, size)
    for i in range(batch.num_rows):
        s, e = first[i], first[i + 1]
        if e - s >= size:
            x = np.sort(grams[s : e - size + 1])
            yield x[np.concatenate([[True], x[1:] != x[:-1]])]
        elif e > s:
            whole = np.uint64(e - s)
            for w in words[s:e]:
                whole = whole * np.uint64(0xFF51AFD7ED558CCD) + w
            yield mix(np.array([whole + np.uint64(1)], dtype=np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def _set_digest(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, size: int, k: int) -> DataFrame:
    """``doc_id, row, n_shingles, same binary, sketch array<bigint>`` of each row; ``same`` is a digest of the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                n, same, low = [], [], []
                with np.errstate(over="ignore"):
                    for x in _sets(batch, size):
                        n.append(len(x))
                        same.append(_set_digest(x) if len(x) else None)
                        low.append(x[:k].view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(low, pa.list_(pa.int64()))], ["doc_id", "row", "n_shingles", "same", "sketch"])

    return docs.mapInArrow(lean(run), "doc_id bigint, row bigint, n_shingles bigint, same binary, sketch array<bigint>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """``same, items binary``: the sorted 64-bit shingle hashes of each text and their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                with np.errstate(over="ignore"):
                    items = [x.tobytes() for x in _sets(batch, size)]
                same = [hashlib.blake2b(x, digest_size=16).digest() for x in items]
                yield pa.RecordBatch.from_arrays([pa.array(same, pa.binary()), pa.array(items, pa.binary())], ["same", "items"])

    return docs.mapInArrow(lean(run), "same binary, items binary")


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and the n + 1 places where its lists begin."""
    at = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths(), dtype=np.int64))])
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), at


def _padded(values: np.ndarray, at: np.ndarray, chosen: np.ndarray, width: int, odd: int) -> np.ndarray:
    """The chosen lists as rows of ``width`` values; what is missing are large numbers that occur once."""
    size = (at[1:] - at[:-1])[chosen]
    out = np.broadcast_to(np.uint64(2**64 - 1 - odd) - 2 * np.arange(width, dtype=np.uint64), (len(chosen), width)).copy()
    place = np.arange(width)[None, :] < size[:, None]
    out[place] = values[(at[:-1][chosen][:, None] + np.arange(width)[None, :])[place]]
    return out


def union_passes(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray, nx: np.ndarray, ny: np.ndarray, k: int, pct: int) -> np.ndarray:
    """For each pair of list i of x and list j of y: whether the sketch of their union leaves room for the threshold; exact where both sketches are whole sets."""
    ok = np.zeros(len(i), dtype=bool)
    nx, ny = nx[i], ny[j]
    todo = np.flatnonzero(100 * np.minimum(nx, ny) >= pct * np.maximum(nx, ny))
    held = np.minimum(np.maximum(nx, ny), k)
    todo = todo[np.argsort(held[todo], kind="stable")]
    p, s = pct / 100, 0
    most = lambda at: max(1, CELLS // (2 * int(held[todo[at]])))
    while s < len(todo):
        e = min(s + most(s), len(todo))
        e = min(s + most(e - 1), e)
        at, width = todo[s:e], int(held[todo[e - 1]])
        both = np.concatenate([_padded(*x, i[at], width, 0), _padded(*y, j[at], width, 1)], axis=1)
        both.sort(axis=1)
        twice = both[:, 1:] == both[:, :-1]  # values are distinct within each sketch
        place = np.arange(2, 2 * width + 1)[None, :] - np.cumsum(twice, axis=1)  # among the values of the union
        shared, hits = twice.sum(axis=1), (twice & (place <= k)).sum(axis=1)
        whole = (nx[at] <= k) & (ny[at] <= k)
        ok[at] = np.where(whole, 100 * shared >= pct * (nx[at] + ny[at] - shared), hits >= k * p - SLACK * np.sqrt(k * p * (1 - p)))
        s = e
    return ok


def _passing(pairs: DataFrame, nodes: DataFrame, k: int, pct: int) -> DataFrame:
    """Of the candidate pairs ``a, b`` those whose union sketch passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = np.arange(batch.num_rows)
            ok = union_passes(_rows(batch.column("sa")), _rows(batch.column("sb")), each, each, batch.column("na").to_numpy(), batch.column("nb").to_numpy(), k, pct)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one = nodes.select("node", "n_shingles", "sketch")
    full = pairs.join(one.toDF("a", "na", "sa"), "a").join(one.toDF("b", "nb", "sb"), "b")
    return full.mapInArrow(lean(run), "a bigint, b bigint")


def _sets_of(wanted: DataFrame, docs: DataFrame, nodes: DataFrame, size: int, path: str) -> DataFrame:
    """``node, items`` of the nodes in ``wanted``, from the rows of their smallest doc_id."""
    named = keep(nodes.select("node", "same", "first").join(wanted.select("node").distinct(), "node", "left_semi"), f"{path}-names")
    ids = keep(named.select(F.col("first").alias("doc_id")).distinct(), f"{path}-ids")
    sets = full_sets(only_ids(docs, ids, "doc_id").select("doc_id", "text"), size).join(named.select("same", "node"), "same")
    return keep(sets.groupBy("node").agg(F.min("items").alias("items")), path)  # a doc_id may have the text twice


def _verified(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """Of the pairs ``a, b`` those whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("xa"), batch.column("xb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(100 * shared >= pct * (len(both) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    full = pairs.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b")
    return full.mapInArrow(lean(run), "a bigint, b bigint")


def _blocks(members: DataFrame, pct: int, weight: int, path: str) -> DataFrame:
    """Deal ``centre, node, size, component`` into groups ``centre, c, kind, i, j`` of two blocks at most; ``side`` tells the two apart.

    Every two members of a centre whose sizes allow the similarity meet in one
    group. Classes of sizes are as wide as the threshold allows, so that a
    class meets itself and the next one only; a class is cut into blocks of
    BLOCK members and, at ``weight`` bytes for each shingle, of BLOCK_BYTES.
    """
    step = max(float(np.log(100 / pct)) * 1.0001, 1e-3)
    members = members.withColumn("c", F.floor(F.log("size") / step).cast("int"))
    n = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") * weight / BLOCK_BYTES)).cast("int")
    count = keep(members.groupBy("centre", "c").agg(n.alias("n"), (F.count(F.lit(1)) > 1).alias("several")), path)
    few = count.count() <= BROADCAST_IDS // 4
    count = F.broadcast(count) if few else count
    near = lambda by, name: (F.broadcast if few else lambda x: x)(count.select("centre", (F.col("c") + by).alias("c"), F.col("n").alias(name)))
    each = members.join(count, ["centre", "c"]).join(near(-1, "up"), ["centre", "c"], "left").join(near(1, "down"), ["centre", "c"], "left")
    each = each.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    group = lambda c, kind, i, j, side: F.struct(c.cast("int").alias("c"), F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    none = F.array().cast("array<struct<c:int,kind:int,i:int,j:int,side:int>>")
    others = lambda n: F.sequence(F.lit(0), n - 1)
    mine, c = F.col("mine"), F.col("c")
    same = F.when(F.col("several"), F.transform(others(F.col("n")), lambda o: group(c, 0, F.least(mine, o), F.greatest(mine, o), mine > o))).otherwise(none)
    up = F.when(F.col("up").isNotNull(), F.transform(others(F.col("up")), lambda o: group(c, 1, mine, o, F.lit(0)))).otherwise(none)
    down = F.when(F.col("down").isNotNull(), F.transform(others(F.col("down")), lambda o: group(c - 1, 1, o, mine, F.lit(1)))).otherwise(none)
    return each.select("centre", "node", "size", "component", F.explode(F.concat(same, up, down)).alias("g")).select("centre", "g.*", "node", "size", "component")


GROUP = ["centre", "c", "kind", "i", "j"]


def _shared(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many values each two of the lists have in common: products of slices of their incidence matrix."""
    m = len(at) - 1
    owner = np.repeat(np.arange(m), np.diff(at))
    _, number, count = np.unique(values, return_inverse=True, return_counts=True)
    several = count[number] > 1
    number, owner = (np.cumsum(count > 1) - 1)[number[several]], owner[several]
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    out, wide = np.zeros((m, m), dtype=np.int64), 4096
    edges = np.searchsorted(number, np.arange(0, int(number[-1]) + 1 + wide, wide)) if len(number) else [0]
    for s, e in zip(edges[:-1], edges[1:], strict=True):
        has = np.zeros((wide, m), dtype=np.float32)
        has[number[s:e] % wide, owner[s:e]] = 1
        out += (has.T @ has).astype(np.int64)
    return out


def _pairs(table: pa.Table, pct: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows i < j of a group that are to be compared: of different sides if there are two, different components, and sizes that allow it."""
    side, component, size = (table.column(c).to_numpy() for c in ("side", "component", "size"))
    ok = component[:, None] != component[None, :]
    ok &= 100 * np.minimum(size[:, None], size[None, :]) >= pct * np.maximum(size[:, None], size[None, :])
    if table.column("i")[0].as_py() != table.column("j")[0].as_py() or table.column("kind")[0].as_py():
        ok &= side[:, None] != side[None, :]
    return np.nonzero(np.triu(ok, 1))


def _with_partner(members: DataFrame, nodes: DataFrame, k: int, pct: int, path: str) -> DataFrame:
    """``centre, node`` of the members that have another one, of another component, whose union sketch with them passes."""

    def run(table: pa.Table) -> pa.Table:
        i, j = _pairs(table, pct)
        found = np.zeros(0, np.int64)
        if len(i):
            lists = _rows(table.column("sketch").combine_chunks())
            size = table.column("size").to_numpy()
            shared = _shared(*lists)[i, j]
            p = pct / 100
            room = np.where((size[i] <= k) & (size[j] <= k), 100 * shared >= pct * (size[i] + size[j] - shared), shared >= k * p - SLACK * np.sqrt(k * p * (1 - p)))
            order = np.argsort(-shared[room], kind="stable")
            i, j = i[room][order], j[room][order]  # what both sketches hold is no less than what their union's does
            has = np.zeros(table.num_rows, dtype=bool)
            while len(i):  # the most promising first; pairs of members that have a partner already need no look
                ok = union_passes(lists, lists, i[:2048], j[:2048], size, size, k, pct)
                has[i[:2048][ok]] = has[j[:2048][ok]] = True
                i, j = i[2048:], j[2048:]
                still = ~(has[i] & has[j])
                i, j = i[still], j[still]
            found = np.flatnonzero(has)
        return table.select(["centre", "node"]).take(pa.array(found))

    dealt = _blocks(members, pct, 0, path).join(nodes.select("node", "sketch"), "node")
    return by_group(dealt, GROUP, run, "centre bigint, node bigint")


def _links(members: DataFrame, sets: DataFrame, pct: int, path: str) -> DataFrame:
    """Links ``a, b`` between members of one centre on their full sets: of those in a group as many as join its components."""

    def run(table: pa.Table) -> pa.Table:
        a, b = [], []
        i, j = _pairs(table, pct)
        if len(i):
            items = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("items")]
            at = np.concatenate([[0], np.cumsum([len(x) for x in items])])
            size = at[1:] - at[:-1]
            shared = _shared(np.concatenate(items), at)[i, j]
            ok = 100 * shared >= pct * (size[i] + size[j] - shared)
            node, component = table.column("node").to_pylist(), table.column("component").to_pylist()
            root = {c: c for c in component}

            def find(c):
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            for x, y in zip(i[ok].tolist(), j[ok].tolist(), strict=True):
                p, q = find(component[x]), find(component[y])
                if p != q:
                    root[max(p, q)] = min(p, q)
                    a.append(node[x])
                    b.append(node[y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return by_group(_blocks(members, pct, 8, path).join(sets, "node"), GROUP, run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold_pct: int = 80, k: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept, row``.

    component_id is the smallest doc_id reachable over links of Jaccard
    similarity ``threshold_pct`` / 100 or more; kept says whether it is the
    row's own. Words are ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, and shingles
    runs of ``shingle`` words; a text of fewer words is one shingle. row is
    ``xxhash64`` of the text.

    A link at the threshold is missed with a chance of 4e-8 at most (README); with
    ``k`` no less than the largest set every sketch is the whole set and none is.

    Null, empty and blank texts have no shingles and are linked with nothing.
    Rows of one doc_id with different texts are nodes of their own: a link of
    one is none of the other, and each has the smallest doc_id that its own
    text reaches. A null doc_id has a null component, is kept, and links
    nothing. Other columns are not read. An empty table gives an empty result.
    """
    spark, pct, t = docs.sparkSession, threshold_pct, tail_share(k, threshold_pct)
    home = work_dir(spark)
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows = keep(sketches(docs.withColumn("row", F.xxhash64("text")), shingle, k), f"{home}/sketched")
    some = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    # one node for equal sets, numbered as it is written
    equal = some.groupBy("same").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    nodes = keep(equal.withColumn("node", F.monotonically_increasing_id()), f"{home}/nodes")
    rows = keep(rows.select("doc_id", "n_shingles", "same", "row"), f"{home}/rows")  # the nodes have the sketches
    drop(spark, f"{home}/sketched")
    listed = nodes.select("node", F.explode("sketch").alias("value"))
    common = keep(listed.groupBy("value").count().where("count > 1"), f"{home}/common")
    # the rarest values: those of one document come first and link nothing
    held = F.least(F.col("n_shingles"), F.lit(k))
    short = F.when(F.col("n_shingles") <= k * pct // 100, F.col("n_shingles") - F.ceil(F.col("n_shingles") * pct / 100) + 1).otherwise(held - F.least(F.lit(t), F.floor(held / 2)) + 1)
    shared = listed.join(common, "value").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("count", "value"))).alias("values"))  # k at most
    shared = shared.join(nodes.select("node", F.col("n_shingles").alias("size"), held.alias("held"), short.alias("short")), "node")
    take = (F.col("short") - (F.col("held") - F.size("values"))).cast("int")
    lists = keep(shared.where(take > 0).select("node", "size", F.explode(F.slice("values", 1, take)).alias("v")).select("node", "size", "v.value"), f"{home}/lists")
    # every list's members against its smallest one
    centre = lists.groupBy("value").agg(F.min(F.struct("node", "size")).alias("c")).select("value", F.col("c.node").alias("centre"), F.col("c.size").alias("size_a"))
    members = keep(lists.join(centre, "value").where(F.col("centre") < F.col("node")).select("centre", "size_a", "node", "size").distinct(), f"{home}/members")
    alike = F.lit(100) * F.least("size", "size_a") >= F.lit(pct) * F.greatest("size", "size_a")  # else the sizes rule the pair out
    stars = keep(_passing(members.where(alike).select(F.col("centre").alias("a"), F.col("node").alias("b")), nodes, k, pct), f"{home}/stars")
    sets = _sets_of(stars.select(F.col("a").alias("node")).union(stars.select("b")), docs, nodes, shingle, f"{home}/sets")
    edges = keep(_verified(stars, sets, pct), f"{home}/edges")
    drop(spark, *(f"{home}/{x}" for x in ("common", "lists", "sets", "stars")))
    found = keep(components(edges, f"{home}/c1"), f"{home}/found")
    # then members in different components; the smallest one has met them all
    several = members.groupBy("centre").count().where("count > 1").select("centre")
    members = members.select("centre", "node", "size").join(several, "centre").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = members.groupBy("centre").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("centre")
    members = keep(members.join(mixed, "centre", "left_semi"), f"{home}/mixed")
    left = keep(_with_partner(members, nodes, k, pct, f"{home}/blocks1").distinct(), f"{home}/left")
    members = keep(members.join(left, ["centre", "node"], "left_semi"), f"{home}/open")
    sets = _sets_of(members, docs, nodes, shingle, f"{home}/open_sets")
    links = keep(edges.union(_links(members, sets, pct, f"{home}/blocks2")), f"{home}/links")
    drop(spark, *(f"{home}/{x}" for x in ("members", "mixed", "left", "open", "open_sets")))
    found = keep(components(links, f"{home}/c2"), f"{home}/components")
    # rows whose component is not their own doc_id alone are joined with it
    lead = found.join(nodes.select("node", "first"), "node")
    lead = lead.join(lead.groupBy("component").agg(F.min("first").alias("lead")), "component").select("node", "lead")
    moved = nodes.select("node", "same", "first", "n").join(lead, "node", "left").where("n > 1 OR lead IS NOT NULL")
    moved = keep(moved.select("same", F.coalesce("lead", "first").alias("lead")), f"{home}/moved")
    out = rows.select("doc_id", "n_shingles", "same", "row").join(moved, "same", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("lead", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "row")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=2).drop("row")
