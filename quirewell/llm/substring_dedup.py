"""Removing passages that an earlier document has, by suffix automata of reference shards.

A passage goes if it is covered by windows of ``window`` words which also start
in a document with a smaller id. Sending every automaton to every document would
cost documents times shards, so text is routed instead: the anchor of a window
is the smallest hash of the shorter runs of words inside it, equal windows have
equal anchors, and only anchors of two documents or more matter. The regions
around such anchors are both the references and what is streamed through them.
Equal regions are one (with the smallest id that has it), so copies and hot
passages shrink before they are shuffled. Regions of one anchor meet in a shard
of bounded size; its suffix automaton, each state carrying the smallest id of
its occurrences, gives matching statistics for the regions streamed through it.
The regions of an anchor that fills more than a shard are cut into their
windows first, equal ones are one again, and these are dealt to shards by hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, drop, keep, lean, mix, only_ids, partitions, pieces, raw, windows, words_of, work_dir

#: Words of a reference shard, twice as many at most.
SHARD_WORDS = 20_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def row_key(text_col: str = "text") -> Column:
    """With the doc_id, tells rows with different texts apart."""
    return F.xxhash64(F.col(text_col))


class SuffixAutomaton:
    """Suffix automaton of several sequences; each state has the smallest owner of its occurrences."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.least = [-1], [0], [1 << 62]

    def _state(self, size: int, owner: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.size.append(size)
        self.least.append(owner)
        return len(self.next) - 1

    def _clone(self, p: int, q: int, word: int) -> int:
        """Split state q so that a state of the size of p and one more word stands alone."""
        c = self._state(self.size[p] + 1, 1 << 62)
        self.next[c] = self.next[q].copy()
        self.link[c] = self.link[q]
        self.link[q] = c
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = c
            p = self.link[p]
        return c

    def add(self, words: list[int], owner: int) -> None:
        last, nxt, link, size = 0, self.next, self.link, self.size
        for word in words:
            q = nxt[last].get(word)
            if q is not None:  # already known from another sequence
                last = q if size[q] == size[last] + 1 else self._clone(last, q, word)
                self.least[last] = min(self.least[last], owner)
                continue
            new, p = self._state(size[last] + 1, owner), last
            while p >= 0 and word not in nxt[p]:
                nxt[p][word] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][word]
                link[new] = q if size[q] == size[p] + 1 else self._clone(p, q, word)
            last = new

    def finish(self) -> None:
        """Carry the smallest owners from longer to shorter strings."""
        for s in sorted(range(1, len(self.next)), key=self.size.__getitem__, reverse=True):
            up = self.link[s]
            if self.least[s] < self.least[up]:
                self.least[up] = self.least[s]

    def least_owners(self, words: list[int], window: int) -> list[int]:
        """Matching statistics: for each window of ``words``, the smallest owner that has it."""
        out, state, length = [], 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            at = state
            while length >= window and self.size[self.link[at]] >= window:
                at = self.link[at]
            out.append(self.least[at] if length >= window else 1 << 62)
        return out[window - 1 :]


def _anchors(batch: pa.RecordBatch, window: int) -> tuple[np.ndarray, ...]:
    """Word hashes, the words' places, and runs of windows that share an anchor: their anchor, row, first window and count."""
    data, at = raw(batch.column("text"))
    words, first = words_of(data, at, lower=False)
    gram = (window + 1) // 2
    none = np.zeros(0, np.int64)
    if len(words) < window:
        return words, first, none.view(np.uint64), none, none, none
    grams = windows(words, gram)
    n = len(words) - window + 1
    anchor = grams[:n].copy()
    for i in range(1, window - gram + 1):
        np.minimum(anchor, grams[i : i + n], out=anchor)
    row = np.searchsorted(first, np.arange(len(words)), side="right") - 1
    inside = row[:n] == row[window - 1 :]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | (anchor[1:] != anchor[:-1]) | (row[1:n] != row[: n - 1])
    begin = np.flatnonzero(starts)
    # a run ends before the next one begins, or where its text ends
    stop = np.minimum(np.append(begin[1:], n), first[row[begin] + 1] - window + 1)
    return words, first, mix(anchor[begin]), row[begin], begin, stop - begin  # minima are small numbers: spread them


def _sequences(docs: DataFrame, window: int) -> DataFrame:
    """``doc_id, row, n_words, same``: a digest of the word sequence where it has a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                with np.errstate(over="ignore"):
                    words, first = words_of(*raw(batch.column("text")), lower=False)
                n = np.diff(first)
                same = [hashlib.blake2b(words[s:e].tobytes(), digest_size=16).digest() if e - s >= window else None for s, e in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(n, pa.int64()), pa.array(same, pa.binary())], ["doc_id", "row", "n_words", "same"])

    return docs.mapInArrow(lean(run), "doc_id bigint, row bigint, n_words bigint, same binary")


def _shared_anchors(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """``doc_id, anchor`` for anchors that two documents or more have.

    Anchors travel packed. Of those that several documents of a batch have, one
    stands for all, so a hot anchor is shuffled once for each batch.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", 8 << 20):
                ids = batch.column("doc_id").to_numpy()
                with np.errstate(over="ignore"):
                    _, _, anchor, row, _, _ = _anchors(batch, window)
                if not len(anchor):
                    continue
                owner = ids[row]
                order = np.lexsort((owner, anchor))
                anchor, owner = anchor[order], owner[order]
                new = np.append(True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]))
                anchor, owner = anchor[new], owner[new]
                head = np.append(True, anchor[1:] != anchor[:-1])
                begin = np.flatnonzero(head)
                count = np.diff(np.append(begin, len(anchor)))
                several = np.repeat(count > 1, count)
                lead, lead_owner, lead_known = anchor[begin], owner[begin], count > 1
                known, known_owner = anchor[several], owner[several]
                cut = np.array([(i << 64) // buckets for i in range(1, buckets)], dtype=np.uint64)
                at, at_known = np.concatenate([[0], np.searchsorted(lead, cut), [len(lead)]]), np.concatenate([[0], np.searchsorted(known, cut), [len(known)]])
                full = [i for i in range(buckets) if at[i + 1] > at[i]]
                column = lambda x, p: pa.array([x[p[i] : p[i + 1]].tobytes() for i in full], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), column(lead, at), column(lead_owner, at), column(lead_known, at), column(known, at_known), column(known_owner, at_known)], ["bucket", "lead", "owner", "done", "known", "known_owner"])

    def meet(table: pa.Table) -> pa.Table:
        read = lambda c, t: np.concatenate([np.frombuffer(x.as_buffer(), t) for x in table.column(c)])
        lead, owner, done = read("lead", np.uint64), read("owner", np.int64), read("done", bool)
        order = np.argsort(lead, kind="stable")
        lead, owner, done = lead[order], owner[order], done[order]
        same = np.zeros(len(lead), dtype=bool)
        same[1:] = lead[1:] == lead[:-1]
        same[:-1] |= same[1:].copy()
        out = same & ~done
        anchor = np.concatenate([lead[out], read("known", np.uint64)]).view(np.int64)
        return pa.table({"doc_id": np.concatenate([owner[out], read("known_owner", np.int64)]), "anchor": anchor})

    packed = docs.mapInArrow(lean(emit), "bucket int, lead binary, owner binary, done binary, known binary, known_owner binary")
    return packed.groupBy("bucket").applyInArrow(meet, "doc_id bigint, anchor bigint")


def _regions(docs: DataFrame, window: int) -> DataFrame:
    """Regions around the wanted anchors of ``doc_id, row, text, anchors``: ``anchor, region, doc_id, row, start, windows, words``; region is a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                with np.errstate(over="ignore"):
                    words, first, anchor, row, begin, count = _anchors(batch, window)
                    lists = batch.column("anchors")
                    wanted = np.zeros(len(anchor), dtype=bool)
                    edge = np.searchsorted(row, np.arange(batch.num_rows + 1))
                    for i in range(batch.num_rows):
                        s, e = edge[i], edge[i + 1]
                        wanted[s:e] = np.isin(anchor[s:e].view(np.int64), lists[i].values.to_numpy(zero_copy_only=False))
                    anchor, row, begin, count = (x[wanted] for x in (anchor, row, begin, count))
                    held = [words[b : b + c + window - 1].tobytes() for b, c in zip(begin, count, strict=True)]
                    region = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) for x in held]
                ids, keys = batch.column("doc_id").to_numpy(), batch.column("row").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(region, pa.int64()), pa.array(ids[row], pa.int64()), pa.array(keys[row], pa.int64()), pa.array(begin - first[row], pa.int64()), pa.array(count, pa.int32()), pa.array(held, pa.binary())], ["anchor", "region", "doc_id", "row", "start", "windows", "words"])

    return docs.mapInArrow(lean(run), "anchor bigint, region bigint, doc_id bigint, row bigint, start bigint, windows int, words binary")


def _solve(pieces_: DataFrame, window: int) -> DataFrame:
    """``anchor, piece, least array<bigint>``: the smallest id that has each window of the distinct pieces ``anchor, bucket, piece, least, words``."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        _, ids = np.unique(np.concatenate([r[4] for r in rows]), return_inverse=True)
        ends = np.cumsum([len(r[4]) for r in rows])
        texts = [ids[e - len(r[4]) : e].tolist() for r, e in zip(rows, ends, strict=True)]
        automaton = SuffixAutomaton()
        for r, text in zip(rows, texts, strict=True):
            automaton.add(text, r[3])
        automaton.finish()
        least = [automaton.least_owners(text, window) for text in texts]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array(least, pa.list_(pa.int64()))], ["anchor", "piece", "least"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for a, b, p, d, w in zip(*(batch.column(c).to_pylist() for c in ("anchor", "bucket", "piece", "least", "words")), strict=True):
                if size > SHARD_WORDS and rows[-1][:2] != (a, b):
                    yield solve(rows)
                    rows, size = [], 0
                words = np.frombuffer(w, np.uint64)
                rows.append((a, b, p, d, words))
                size += len(words)
        if rows:
            yield solve(rows)

    dealt = pieces_.repartition("anchor", "bucket").sortWithinPartitions("anchor", "bucket")
    return dealt.select("anchor", "bucket", "piece", "least", "words").mapInArrow(lean(run), "anchor bigint, piece bigint, least array<bigint>")


def _cut(regions: DataFrame, window: int) -> DataFrame:
    """``anchor, region, i, piece, least, words``: the windows of regions ``anchor, region, least, words``; piece is a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "words", 256 << 10):
                each = [np.frombuffer(w.as_buffer(), np.uint64) for w in batch.column("words")]
                count = np.array([len(w) - window + 1 for w in each])
                with np.errstate(over="ignore"):
                    hashes = np.concatenate([windows(w, window) for w in each]).view(np.int64)
                held = [x.tobytes() for w in each for x in np.lib.stride_tricks.sliding_window_view(w, window)]
                row = pa.array(np.repeat(np.arange(len(each)), count))
                place = np.concatenate([np.arange(c) for c in count])
                yield pa.RecordBatch.from_arrays([batch.column("anchor").take(row), batch.column("region").take(row), pa.array(place, pa.int32()), pa.array(hashes), batch.column("least").take(row), pa.array(held, pa.binary())], ["anchor", "region", "i", "piece", "least", "words"])

    return regions.mapInArrow(lean(run), "anchor bigint, region bigint, i int, piece bigint, least bigint, words binary")


def _spans(occurrences: DataFrame, found: DataFrame) -> DataFrame:
    """``doc_id, row, at``: the windows that go, a list for each row."""
    hit = F.filter(F.transform("least", lambda x, i: F.when(x < F.col("doc_id"), F.col("start") + i)), lambda x: x.isNotNull())
    rows = occurrences.join(found, ["anchor", "region"]).select("doc_id", "row", hit.alias("at")).where(F.size("at") > 0)
    return rows.groupBy("doc_id", "row").agg(F.flatten(F.collect_list("at")).alias("at"))  # a row's own windows


def _apply(docs: DataFrame, window: int, with_text: bool) -> DataFrame:
    """The rows of ``doc_id, row, text, at``: what is left of each text without the words that the windows starting at ``at`` cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                n, gone, sha, left = [], [], [], []
                for text, at in zip(batch.column("text").to_pylist(), batch.column("at"), strict=True):
                    words = (text or "").encode().split()
                    n.append(len(words))
                    if at.is_valid and len(at.values):
                        edge = np.zeros(len(words) + window + 1, np.int64)
                        starts = at.values.to_numpy(zero_copy_only=False)
                        np.add.at(edge, starts, 1)
                        np.add.at(edge, starts + window, -1)
                        covered = np.cumsum(edge)[: len(words)] > 0
                        words = [w for w, c in zip(words, covered.tolist(), strict=True) if not c]
                    kept = b" ".join(words)
                    gone.append(n[-1] - len(words))
                    sha.append(hashlib.sha256(kept).hexdigest())
                    left.append((text if not gone[-1] else kept.decode()) if with_text else None)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha), pa.array(left, pa.string()), batch.column("row")], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "row"])

    return docs.mapInArrow(lean(run), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string, row bigint")


def deduplicate_substrings(docs: DataFrame, window: int = 13, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256, kept_text, row``.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. kept_text is filled with
    ``with_text``: the text as it was if nothing goes, else the kept words
    joined by one space. row is the ``row_key`` of the row.

    Null and blank texts have no words. A word sequence that a document with a
    smaller id has as a whole goes altogether. Rows of one doc_id are one
    document: each keeps what only they have. A null doc_id takes no part and
    loses nothing. Other columns are not read. An empty table gives an empty
    result.
    """
    spark, key = docs.sparkSession, ["doc_id", "row"]
    home = work_dir(spark)
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).withColumn("row", row_key())
    rows = keep(_sequences(docs.where("doc_id IS NOT NULL"), window), f"{home}/rows")
    same = rows.where("same IS NOT NULL").groupBy("same").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    same = keep(same, f"{home}/same")  # a table of its own, so that a hot text's rows can be split in the join
    copies = keep(rows.join(same, "same").where("doc_id > first").select(*key).distinct(), f"{home}/copies")
    few = copies.count() <= BROADCAST_IDS
    minus = lambda x, ids, small: x.join(F.broadcast(ids) if small else ids, key, "left_anti")
    first_ones = minus(docs.where("doc_id IS NOT NULL"), copies, few)
    shared = keep(_shared_anchors(first_ones, window, 2 * partitions(spark)), f"{home}/shared")
    lists = keep(shared.groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")), f"{home}/lists")
    with_lists = only_ids(first_ones, lists.select("doc_id"), "doc_id").join(lists, "doc_id")
    regions = keep(_regions(with_lists, window), f"{home}/regions")
    drop(spark, f"{home}/shared", f"{home}/lists")
    keys = keep(regions.groupBy("anchor", "region").agg(F.min("doc_id").alias("least"), F.first("words").alias("words")), f"{home}/keys")
    words = (F.octet_length("words") / 8).cast("bigint")
    large = keys.groupBy("anchor").agg(F.sum(words).alias("n"), F.sum(words - window + 1).alias("windows")).where(F.col("n") > SHARD_WORDS)
    large = keep(large.select("anchor", F.ceil(F.col("windows") * window / SHARD_WORDS).cast("int").alias("buckets")), f"{home}/large")
    spread = large.count() <= BROADCAST_IDS
    large_too = F.broadcast(large) if spread else large
    plain = keys.join(large_too, "anchor", "left_anti").select("anchor", F.lit(0).alias("bucket"), F.col("region").alias("piece"), "least", "words")
    cut = keep(_cut(keys.join(large_too.select("anchor"), "anchor", "left_semi"), window), f"{home}/cut")
    single = cut.groupBy("anchor", "piece").agg(F.min("least").alias("least"), F.first("words").alias("words"))
    single = single.join(large_too, "anchor").select("anchor", F.pmod("piece", "buckets").cast("int").alias("bucket"), "piece", "least", "words")
    found = keep(_solve(plain, window).withColumnRenamed("piece", "region"), f"{home}/found")
    single = keep(_solve(single, window).select("anchor", "piece", F.element_at("least", 1).alias("least")), f"{home}/single")
    placed = cut.select("anchor", "region", "i", "piece").join(single, ["anchor", "piece"])
    placed = placed.groupBy("anchor", "region").agg(F.array_sort(F.collect_list(F.struct("i", "least"))).alias("x"))  # a region's own windows
    placed = keep(placed.select("anchor", "region", F.col("x.least").alias("least")), f"{home}/placed")
    spans = keep(_spans(regions.select("anchor", "region", "doc_id", "row", "start"), found.union(placed)), f"{home}/spans")
    drop(spark, *(f"{home}/{x}" for x in ("regions", "keys", "cut", "found", "single", "placed")))
    # copies lose all, documents with spans are joined with them, the others are taken as they are
    hit = keep(spans.select(*key), f"{home}/hit")
    small = hit.count() <= BROADCAST_IDS
    touched = first_ones.join(F.broadcast(hit) if small else hit, key, "left_semi").join(spans, key).select(*key, "text", "at")
    clean = minus(minus(docs, copies, few), hit, small).select(*key, "text", F.lit(None).cast("array<bigint>").alias("at"))
    all_gone = rows.join(F.broadcast(copies) if few else copies, key, "left_semi").select("doc_id", "n_words", F.col("n_words").alias("n_removed"), F.lit(EMPTY_SHA).alias("kept_sha256"), F.lit("" if with_text else None).cast("string").alias("kept_text"), "row")
    return _apply(clean, window, with_text).union(_apply(touched, window, with_text)).union(all_gone)


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text", "row")
