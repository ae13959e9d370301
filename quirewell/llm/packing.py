"""Packing documents into sequences by cutting-stock column generation.

Documents are tokenised and cut into full pieces and a remainder. The histogram
of remainder lengths (a fixed number of classes, however many documents) is the
demand of a cutting-stock problem; its linear program is solved on the driver by
column generation, a knapsack dynamic program pricing the columns. Rounded
patterns give, for each class, runs of ranks; the pieces are ranked in Spark and
look up their sequence by rank.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, lean, partitions, pieces, work_dir

SMOOTH = 0.9  # weight of the best dual prices so far
#: Words that a worker remembers the ids of, in each of two generations: those in use move to the new one before the old one goes.
REMEMBER, REMEMBER_BYTES = 500_000, 64
#: A full stop or comma between a letter and white space: a token of its own.
STOP = re.compile(rb"(?<=[a-z])([.,])(?=[\x20\x09-\x0D]|\Z)")


# ---- tokenising -----------------------------------------------------------


class WordIds:
    """Ids of a tokenizer that drops white space and treats each word by itself.

    Words are the runs between ASCII white space; each distinct one is encoded
    by the tokenizers library once and remembered.
    """

    def __init__(self, path: str, remember: int = REMEMBER) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.remember = remember
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def of(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def encode(self, text: str) -> bytes:
        """The ids of a text, each as a little-endian unsigned 32-bit number."""
        data = text.encode()
        # lower-casing A-Z first changes nothing but where a combining mark (U+0300 to U+036F) or a special token stands
        if b"<|" not in data and b"\xcc" not in data and b"\xcd" not in data:
            data = STOP.sub(rb" \1", data.lower())
        words = data.split()
        if len(self.known) > self.remember:
            self.known, self.old = {}, self.known
        new, old = [], self.old
        for w in set(words).difference(self.known):
            if w in old:
                self.known[w] = old[w]
            else:
                new.append(w)
        long = [w for w in new if len(w) > REMEMBER_BYTES]
        new = [w for w in new if len(w) <= REMEMBER_BYTES]
        if new:
            self.known.update(zip(new, self.of(new), strict=True))
        if long:
            own = dict(zip(long, self.of(long), strict=True))
            return b"".join([self.known.get(w) or own.get(w, b"") for w in words])
        return b"".join(map(self.known.__getitem__, words))


_loaded: dict[str, WordIds] = {}


def cut(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, with_ids: bool, remember: int = REMEMBER) -> DataFrame:
    """Full pieces of ``capacity`` ids and the remainder of each document: ``doc_id, start, length, ids_crc32, doc_tokens, spread[, ids]``.

    ``spread`` tells pieces of null ids apart, whose other columns may all be equal.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    last = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _loaded:
            _loaded[vocabulary] = WordIds(vocabulary)
        ids = _loaded[vocabulary]
        ids.remember = remember
        for whole in batches:
            for batch in pieces(whole, "text"):
                at, start, length, crc, total, held = [], [], [], [], [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    x = (ids.encode(text) if text else b"") + last
                    n = len(x) // 4
                    for s in range(0, n, capacity):
                        piece = x[4 * s : 4 * (s + capacity)]
                        at.append(i)
                        start.append(s)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                        if with_ids:
                            held.append(np.frombuffer(piece, dtype="<u4").astype(np.int32))
                ids_ = batch.column("doc_id").take(pa.array(at, pa.int64()))
                spread = pa.array(np.where(np.asarray(ids_.is_null()), np.arange(len(at)), 0), pa.int32())
                columns = [ids_, *(pa.array(x, pa.int64()) for x in (start, length, crc, total)), spread]
                if with_ids:
                    columns.append(pa.array(held, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "spread", *["ids"] * with_ids])

    return docs.mapInArrow(lean(run), f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, spread int" + ", ids array<int>" * with_ids)


# ---- cutting stock --------------------------------------------------------


def knapsack(value: np.ndarray, sizes: np.ndarray, capacity: int, most: int) -> list[tuple[float, np.ndarray]]:
    """The best multisets of items (any number of each) that fit, by dynamic programming over the capacity.

    The first is the best of all; the others, ``most`` at most, are the best that hold a given item.
    """
    worth, took, fits = [0.0] * (capacity + 1), [-1] * (capacity + 1), np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    table = np.zeros(capacity + 1)
    for c in range(int(sizes[0]), capacity + 1):
        got = table[c - sizes[: fits[c]]] + value[: fits[c]]
        k = int(got.argmax())
        table[c] = worth[c] = max(worth[c - 1], float(got[k]))
        if got[k] > worth[c - 1] + 1e-12:
            took[c] = k
    forced = table[capacity - sizes] + value
    out = []
    for k in np.argsort(-forced)[:most]:
        pattern, c = np.zeros(len(sizes)), capacity - int(sizes[k])
        pattern[k] = 1
        while c > 0:
            if took[c] < 0:
                c -= 1
            else:
                pattern[took[c]] += 1
                c -= int(sizes[took[c]])
        out.append((float(forced[k]), pattern))
    return out


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-3, most: int = 400, columns: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used, in the linear program that covers the demand with the fewest sequences.

    A revised simplex: the basis starts with one pattern for each size; each
    round prices new ones by ``knapsack``. It ends at the optimum, or once the
    dual bound shows the value to be within ``gap`` of it, or after ``most``
    rounds. In each case the used patterns meet the demand with equality.
    """
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    used = inverse @ demand
    bound, centre = 0.0, None  # the best dual prices so far; pricing near them needs fewer rounds
    for round_ in range(most):
        if round_ % 20 == 19:  # rounding errors gather
            inverse = np.linalg.inv(basis)
            used = np.maximum(inverse @ demand, 0)
        price = np.maximum(inverse.sum(axis=0), 0)
        if centre is None:
            centre = sizes / capacity
        smooth = SMOOTH * centre + (1 - SMOOTH) * price
        found = knapsack(smooth, sizes, capacity, columns)
        if demand @ smooth / found[0][0] > bound:
            bound, centre = demand @ smooth / found[0][0], smooth / found[0][0]
        if used.sum() - bound <= gap * used.sum():
            break
        for _, pattern in found:
            if inverse.sum(axis=0) @ pattern <= 1 + 1e-9:
                continue
            way = np.einsum("ij,j->i", inverse, pattern)  # small: threads of a linear algebra library would only wait for each other
            ratio = np.where(way > 1e-9, used / np.where(way > 1e-9, way, 1), np.inf)
            out = int(ratio.argmin())
            step = ratio[out]
            if not np.isfinite(step):
                continue
            used = np.maximum(used - step * way, 0)
            used[out] = step
            basis[:, out] = pattern
            row = inverse[out] / way[out]
            inverse -= np.outer(way, row)
            inverse[out] = row
    return basis, used


def rounded(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole patterns with their counts that cover the demand exactly.

    The linear program's counts are rounded down; what is left, a few items for
    each size at most, goes largest first to where it fits tightest.
    """
    basis, used = column_generation(sizes, demand, capacity)
    whole = np.floor(used + 1e-6).astype(np.int64)
    patterns = basis.round().astype(np.int64)
    left = demand - patterns @ whole
    for p in np.argsort(-used):  # rounding errors in `used`: never more than the demand
        while (left < 0).any() and whole[p] and (patterns[left < 0, p] > 0).any():
            whole[p] -= 1
            left += patterns[:, p]
    out = [(patterns[:, p], int(whole[p])) for p in range(len(whole)) if whole[p]]
    room: list[int] = []
    filled: list[np.ndarray] = []
    for k in np.argsort(-sizes):
        for _ in range(int(left[k])):
            fit = [i for i, r in enumerate(room) if r >= sizes[k]]
            if fit:
                i = min(fit, key=room.__getitem__)
            else:
                i = len(room)
                room.append(capacity)
                filled.append(np.zeros(len(sizes), np.int64))
            room[i] -= int(sizes[k])
            filled[i][k] += 1
    return out + [(p, 1) for p in filled]


def classes(lengths: np.ndarray, counts: np.ndarray, most: int, unit: int) -> np.ndarray:
    """The class of each length, named by its size in units, for at most ``most`` classes.

    A class is sized by its longest length. Starting from one class, that which
    wastes most is split where it saves most; dense lengths get narrow classes.
    """
    up = -(-lengths // unit)
    n, area = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    waste = lambda lo, hi: (n[hi] - n[lo]) * up[hi - 1] * unit - (area[hi] - area[lo])
    heap, ends = [(-int(waste(0, len(up))), 0, len(up))] if len(up) else [], {len(up)}
    while heap and len(ends) < most:
        _, lo, hi = heapq.heappop(heap)
        cuts = np.flatnonzero(up[lo : hi - 1] != up[lo + 1 : hi]) + lo + 1
        if not len(cuts):
            continue
        saves = (n[cuts] - n[lo]) * (up[hi - 1] - up[cuts - 1])
        at = int(cuts[saves.argmax()])
        ends.add(at)
        for a, b in ((lo, at), (at, hi)):
            heapq.heappush(heap, (-int(waste(a, b)), a, b))
    ends = np.array(sorted(ends))
    return up[ends[np.searchsorted(ends, np.arange(len(up)), side="right")] - 1] if len(up) else up


def plan(histogram: dict[int, int], capacity: int) -> pd.DataFrame:
    """Runs of ranks for each class: rank r in [lo, hi) goes to sequence ``first + (r - lo) // each``, slot ``slot + (r - lo) % each``."""
    sizes = np.array(sorted(histogram), dtype=np.int64)
    demand = np.array([histogram[s] for s in sizes], dtype=np.int64)
    rows, first, rank = [], 0, np.zeros(len(sizes), np.int64)
    for pattern, times in rounded(sizes, demand, capacity) if len(sizes) else []:
        slot = 0
        for k in np.flatnonzero(pattern)[::-1]:
            each = int(pattern[k])
            rows.append((int(sizes[k]), int(rank[k]), int(rank[k]) + each * times, first, each, slot))
            rank[k] += each * times
            slot += each
        first += times
    if (rank != demand).any():
        raise AssertionError("patterns don't meet the demand")
    return pd.DataFrame(rows, columns=["size", "lo", "hi", "first", "each", "slot"]).sort_values(["size", "lo"], ignore_index=True)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 2, most_classes: int = 256, unit: int = 8, with_ids: bool = False, remember: int = REMEMBER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]``.

    Lengths are rounded up to at most ``most_classes`` sizes, whole numbers of
    ``unit`` ids, in the plan only: pieces lie in their sequence without gaps. Null and empty texts are a document of one id,
    the end. Every row is a document of its own, repeated ones and those with a
    null id too. An empty table gives no pieces. Other columns are not read.
    Workers ``remember`` so many words twice over, some 200 bytes each; it
    changes the speed only.
    """
    spark = docs.sparkSession
    home = work_dir(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    cuts = keep(cut(rows, vocabulary, capacity, end_id, with_ids, remember), f"{home}/cuts")
    found = cuts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).orderBy("length").toPandas()  # as many rows as the capacity at most
    found["size"] = classes(found["length"].to_numpy(), found["n"].to_numpy(), most_classes, unit)
    histogram = found.groupby("size")["n"].sum().to_dict()
    sizes = spark.createDataFrame(found[["length", "size"]].astype("int64"), "length bigint, size bigint")
    blocks = partitions(spark)
    # a class may hold most pieces: they are ranked by block, then across blocks
    cuts = cuts.join(F.broadcast(sizes), "length").withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "spread"), F.lit(blocks)))
    counts = cuts.groupBy("size", "block").agg(F.count(F.lit(1)).alias("n"))
    counts = keep(counts.withColumn("before", F.sum("n").over(Window.partitionBy("size").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))), f"{home}/counts")
    runs = plan(histogram, capacity // unit)
    at = {c: runs[c].to_numpy() for c in runs.columns}
    key = at["size"] * (1 << 44) + at["lo"]

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            k = np.searchsorted(key, f["size"].to_numpy() * (1 << 44) + f["rank"].to_numpy(), side="right") - 1
            r = f["rank"].to_numpy() - at["lo"][k]
            f["sequence_id"] = at["first"][k] + r // at["each"][k]
            f["slot"] = at["slot"][k] + r % at["each"][k]
            yield f.drop(columns=["size", "rank"])

    local = F.row_number().over(Window.partitionBy("size", "block").orderBy(F.col("doc_id").asc_nulls_last(), "start", "ids_crc32", "spread")) - 1
    ranked = cuts.withColumn("local", local).join(counts.select("size", "block", "before"), ["size", "block"])
    ranked = ranked.withColumn("rank", (F.col("local") + F.coalesce(F.col("before"), F.lit(0))).cast("long")).drop("local", "before", "block", "spread")
    fields = [f"{c} {t}" for c, t in ranked.dtypes if c not in ("size", "rank")]
    placed = ranked.mapInPandas(place, ", ".join([*fields, "sequence_id bigint", "slot bigint"]))
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("offset", F.coalesce(before, F.lit(0)).cast("long")).drop("slot")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
