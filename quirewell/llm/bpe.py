"""Byte-level BPE by dynamic programming over prefixes.

Every prefix of a pre-token has exactly one encoding, so it is enough to store
its last token. A token can be the last one of a prefix if it is a suffix of it
(an automaton over the vocabulary, whose suffix links list the shorter matches,
finds these) and if it is compatible with the last token of the prefix before
it: encoding the two together must give back just these two. The longest such
token is the one; back-pointers give the ids.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import pieces, work_dir

#: Pre-tokens of byte-level BPE; white space is Unicode's White_Space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pre-tokens and pairs that a worker remembers; beyond that it starts anew.
REMEMBER = 400_000
#: Longer pre-tokens are encoded but not remembered.
REMEMBER_CHARS = 64


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder of one vocabulary file (tokenizers' JSON, byte-level BPE without normaliser)."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        model, letters = spec["model"], byte_alphabet()
        vocab: dict[str, int] = model["vocab"]
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pattern = regex.compile(PATTERN)
        #: rank of the merge that makes a token (-1: a single byte), its two parts, and the token of each pair
        self.rank = dict.fromkeys(vocab.values(), -1)
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for at, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            token = vocab[a + b]
            self.merged[vocab[a], vocab[b]] = at
            if token not in self.parts:
                self.parts[token], self.rank[token] = (vocab[a], vocab[b]), at
        self.automaton = ahocorasick.Automaton()
        for text, i in vocab.items():
            if len(text) == 1 or i in self.parts:
                as_bytes = self.bytes_of[i]
                self.automaton.add_word(as_bytes.decode("latin-1"), (len(as_bytes), i))
        self.automaton.make_automaton()
        self.whole = {self.bytes_of[i]: i for i in vocab.values()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.ids_of: dict[str, bytes] = {}
        self.text_of: dict[str, bytes] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether encoding the bytes of ``left`` and ``right`` together gives these two tokens.

        Merges are undone from the latest back, along the seam; if at some point
        the tokens at the seam merge before the merges that stand, the pair breaks.
        """
        rank, parts, merged = self.rank, self.parts, self.merged
        until = len(rank)  # merges from here on have been undone
        while True:
            at = merged.get((left, right), -1)
            if 0 <= at < until:
                return False
            if rank[left] > rank[right]:  # the later of the two is undone, equal: the right one
                until, left = rank[left], parts[left][1]
            elif rank[right] >= 0:
                until, right = rank[right] + 1, parts[right][0]
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        one = self.whole.get(piece)
        if one is not None:
            return [one]
        n, fits = len(piece), self.fits
        last: list[int] = [-1] * (n + 1)
        back = [0] * (n + 1)
        for end, (size, token) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size
            if start:
                pair = (last[start], token)
                if pair[0] < 0:
                    continue
                ok = fits.get(pair)
                if ok is None:
                    if len(fits) > REMEMBER:
                        fits.clear()
                    ok = fits[pair] = self.compatible(*pair)
                if not ok:
                    continue
            last[end], back[end] = token, start
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return out[::-1]

    def encode_plain(self, text: str) -> list[int]:
        """Ids of a text in which no special token stands."""
        return [i for piece in self.pattern.findall(text) for i in self.encode_piece(piece.encode())]

    def encode(self, text: str) -> list[int]:
        """Ids of a text; the string of a special token gives its id."""
        if not self.special_pattern:
            return self.encode_plain(text)
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += self.encode_plain(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self.encode_plain(text[at:])

    def decode(self, ids: list[int]) -> bytes:
        """The text of the ids in UTF-8; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace").encode()

    def both(self, text: str) -> tuple[bytes, bytes]:
        """Decimal ids joined by commas, and the decoded text.

        Pre-tokens are encoded and decoded one by one and remembered. Texts with
        a special token are encoded as a whole.
        """
        if not text:
            return b"", b""
        if self.special_pattern is None or not self.special_pattern.search(text):
            chunks = self.pattern.findall(text)
            if len(self.ids_of) > REMEMBER:
                self.ids_of.clear()
                self.text_of.clear()
            long: dict[str, tuple[bytes, bytes]] = {}
            for chunk in set(chunks).difference(self.ids_of):
                ids = self.encode_piece(chunk.encode())
                found = ",".join(map(str, ids)).encode(), b"".join(map(self.bytes_of.__getitem__, ids))
                if len(chunk) > REMEMBER_CHARS:
                    long[chunk] = found
                else:
                    self.ids_of[chunk], self.text_of[chunk] = found
            if long:
                each = [long.get(c) or (self.ids_of[c], self.text_of[c]) for c in chunks]
                ids, plain = b",".join(x for x, _ in each), b"".join(x for _, x in each)
            else:
                ids, plain = b",".join(map(self.ids_of.__getitem__, chunks)), b"".join(map(self.text_of.__getitem__, chunks))
            return ids, plain.decode("utf-8", "replace").encode()
        ids = self.encode(text)
        return ",".join(map(str, ids)).encode(), self.decode(ids)


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The vocabulary of this worker, read once."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    Whole texts are encoded, then decoded from their ids. Null and empty texts
    have no ids: n_tokens 0 and the digest of the empty string twice. Repeated
    rows and null ids are kept; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    work_dir(docs.sparkSession)  # for its bound on batches

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for whole in batches:
            for batch in pieces(whole, "text"):
                n, ids_sha, text_sha = [], [], []
                for text in batch.column("text").to_pylist():
                    ids, decoded = bpe.both(text or "")
                    n.append(ids.count(b",") + 1 if ids else 0)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(decoded).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encode_ids(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, ids array<int>``; null and empty texts have none."""
    kind = docs.schema[id_col].dataType.simpleString()
    work_dir(docs.sparkSession)  # for its bound on batches

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for whole in batches:
            for batch in pieces(whole, "text"):
                ids = [list(map(int, x.split(b","))) if (x := bpe.both(t or "")[0]) else [] for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_ids(rows: DataFrame, vocabulary: str, id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``doc_id, ids``: ``doc_id, text``; null ids give an empty text."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            text = [bpe.decode(x or []).decode() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return rows.selectExpr(f"`{id_col}` AS doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
