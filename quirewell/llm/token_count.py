"""Token counts of byte-level BPE: symbols minus merges.

A pre-token starts as one symbol a byte, in a doubly linked list. A heap holds
the adjacent pairs that have a merge, by its rank, then by place; the lowest is
popped and merged until none is left. Every merge takes one symbol away, so the
count is the number of bytes less the merges; no list of ids is made. An entry
of the heap whose pair has changed since is passed over.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .bpe import PATTERN, REMEMBER, REMEMBER_CHARS, byte_alphabet
from .common import pieces, work_dir

#: Documents with more tokens are marked.
LIMIT = 512


class Merges:
    """The merges of one vocabulary file (tokenizers' JSON, byte-level BPE without normaliser)."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_alphabet()
        if model["type"] != "BPE" or spec.get("normalizer") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: only byte-level BPE without normaliser, whose special tokens match as they stand")
        vocab: dict[str, int] = model["vocab"]
        self.symbol = [0] * 256
        for letter, byte in letters.items():
            self.symbol[byte] = vocab[letter]
        #: (rank, merged symbol) of each pair
        self.pair: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, both in enumerate(model["merges"]):
            a, b = both if isinstance(both, list) else both.split(" ")
            self.pair[vocab[a], vocab[b]] = rank, vocab[a + b]
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def merge(self, piece: bytes) -> int:
        """Tokens of one pre-token."""
        n, pair = len(piece), self.pair
        if n < 2:
            return n
        symbol = [self.symbol[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], i) for i in range(n - 1) if (found := pair.get((symbol[i], symbol[i + 1])))]
        heapq.heapify(heap)
        left = n
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if symbol[i] < 0 or j >= n:
                continue  # merged away, or the last symbol by now
            found = pair.get((symbol[i], symbol[j]))
            if not found or found[0] != rank:
                continue
            symbol[i], symbol[j] = found[1], -1
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := pair.get((symbol[i], symbol[k])):
                    heapq.heappush(heap, (found[0], i))
            h = before[i]
            if h >= 0 and (found := pair.get((symbol[h], symbol[i]))):
                heapq.heappush(heap, (found[0], h))
        return left

    def plain(self, text: str) -> int:
        """Tokens of a text in which no special token stands."""
        chunks, known = self.pattern.findall(text), self.known
        if len(known) > REMEMBER:
            known.clear()
        long: dict[str, int] = {}
        for chunk in set(chunks).difference(known):
            (known if len(chunk) <= REMEMBER_CHARS else long)[chunk] = self.merge(chunk.encode())
        if long:
            return sum(long[c] if c in long else known[c] for c in chunks)
        return sum(map(known.__getitem__, chunks))

    def count(self, text: str) -> int:
        """Tokens of a text; the string of a special token is one."""
        if self.special is None or not (found := list(self.special.finditer(text))):
            return self.plain(text)
        edges = [0, *(e for m in found for e in m.span()), len(text)]
        return len(found) + sum(self.plain(text[a:b]) for a, b in zip(edges[::2], edges[1::2], strict=True))


_loaded: dict[str, Merges] = {}


def load(path: str) -> Merges:
    """The merges of this worker, read once."""
    if path not in _loaded:
        _loaded[path] = Merges(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit``.

    Whole texts are counted; a null text counts as empty, with no bytes and no
    tokens. ``over_limit`` says whether there are more than ``limit`` tokens.
    Repeated rows and null ids are kept, one row each; an empty table gives an
    empty result; other columns are not read. A map over partitions: nothing
    is shuffled, and a lost task is run again by itself.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    work_dir(docs.sparkSession)  # for its bound on batches

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = load(vocabulary)
        for whole in batches:
            for batch in pieces(whole, "text"):
                text = batch.column("text")
                size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
                n = pa.array([merges.count(t) if t else 0 for t in text.to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op11_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), LIMIT)
