"""Token counts, ranked lexical search and hard negatives against the library and plain versions."""

import math
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from test_edges import LONG, ROWS, docs

from quirewell.llm import hard_negatives, lexical_rank, token_count

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE_BPE)


def test_counts_as_the_library(tokenizer):
    rng = np.random.default_rng(1)
    merges = token_count.Merges(BYTE_BPE)
    letters = list("aaabtheing  \n\t.,'0159éüß漢字😀  \x00") + [" the", "'ll", "<|endoftext|>", "<|endof", "\r\n", "ing"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 80))) for _ in range(1500)] + ["a" * 3000, "the" * 2000, " " * 500 + "x", "<|endoftext|>", "\U0001f600" * 300]
    for text in texts:
        assert merges.count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids), text


def test_counts_edges(spark, tokenizer):
    rows = [*ROWS, (20, "<|endoftext|>a<|endoftext|>", "en"), (21, "x" * 200_000, "en")]
    got = plain(token_count.count_tokens(docs(spark, rows), BYTE_BPE, limit=3).collect())
    size = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    assert got == plain([(i, len((t or "").encode()), size(t), size(t) > 3) for i, t, _ in rows])
    assert token_count.count_tokens(docs(spark, ROWS).limit(0), BYTE_BPE).collect() == []


def test_op11(spark, tokenizer):
    got = token_count.op11_token_count(spark, "/root/testdata/sf0.001").collect()
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    sizes = [len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) for r in rows]
    assert plain(got) == plain([(r["doc_id"], len((r["text"] or "").encode()), n, n > 512) for r, n in zip(rows, sizes, strict=True)])


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def naive_ranks(rows, items, k=10):
    split = lambda t: TERM.findall((t or "").translate(LOWER))
    held = [(i, Counter(split(t))) for i, t in rows]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(split(t))
    for item, terms in asked.items():
        scored = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return out


def test_terms():
    text = "A-b_É'ß ZZ9[x]{y}~\x7f漢字 k\x00n"
    assert [t.decode() for t in lexical_rank.terms_of(text)] == TERM.findall(text.translate(LOWER))


@pytest.mark.parametrize("block,asked", [(4096, 1 << 20), (7, 1 << 20), (16, 60)])
def test_ranks(spark, monkeypatch, block, asked):
    """Ties, nulls, blanks, repeated rows and ids, several blocks and several passes over the documents."""
    monkeypatch.setattr(lexical_rank, "BLOCK", block)
    monkeypatch.setattr(lexical_rank, "ASKED_BYTES", asked)
    rng = np.random.default_rng(block)
    say = lambda n: " ".join(f"W{int(x)}" for x in np.minimum(rng.zipf(1.3, n), 60))
    texts = [say(rng.integers(1, 40)) for _ in range(150)]
    rows = list(enumerate(texts)) + [(500, texts[3]), (400, texts[3]), (400, texts[3]), (None, texts[3]), (501, None), (502, " -- "), (503, LONG)]
    items = [(i, say(rng.integers(1, 12))) for i in range(12)] + [(3, "w1 w2"), (20, None), (21, "..."), (22, "nowhere"), (None, "w5 w6"), (23, "w29999 w7"), (24, texts[3])]
    frame = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id bigint, text string, item_id int, n int, term int").repartition(3)
    got = lexical_rank.rank_documents(frame, spark.createDataFrame(items, "item_id bigint, text string"))
    assert plain(got.collect()) == plain(naive_ranks(rows, items))
    assert lexical_rank.rank_documents(frame.limit(0), spark.createDataFrame(items, "item_id bigint, text string")).collect() == []
    assert lexical_rank.rank_documents(frame, spark.createDataFrame(items[:0], "item_id bigint, text string")).collect() == []


def test_pair_bounds():
    """A block's bounds are never below a document's score, and pairs tighten them."""
    rng = np.random.default_rng(4)
    tighter = 0
    for _ in range(200):
        n = int(rng.integers(2, 7))
        impact = rng.integers(1, 50, (20, n)) * (rng.random((20, n)) < 0.4)
        most = impact.max(axis=0)
        both = lambda i: (impact[:, i] > 0) & (impact[:, i + 1] > 0)
        joint = [max(most[i], most[i + 1], (impact[:, i] + impact[:, i + 1])[both(i)].max(initial=0)) for i in range(n - 1)]
        bound = lexical_rank.suffix_bounds(most.tolist(), joint)
        for i in range(n):
            assert impact[:, i:].sum(axis=1).max() <= bound[i] <= most[i:].sum()
        tighter += bound[0] < most.sum()
    assert tighter > 100


def test_op12(spark):
    read = lambda t: [(r[0], r[1]) for r in spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").select("doc_id" if t == "documents" else "item_id", "text").collect()]
    assert plain(lexical_rank.op12_lexical_rank(spark, "/root/testdata/sf0.001").collect()) == plain(naive_ranks(read("documents"), read("benchmark")))


def naive_negatives(rows, anchor, positives=5, negatives=3, low=50, high=95):
    rows = sorted({(i, la, tuple(math.floor(256 * float(x)) for x in v)) for i, v, la in rows if i is not None and la is not None and v and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for i, la, v in rows:
        if not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, lb) for j, lb, w in rows if j != i)
        for s, j, lb in [r for r in scored if r[2] == la][:positives]:
            fits = [r for r in scored if r[2] != la and low * -s <= 100 * -r[0] <= high * -s][:negatives]
            out += [(i, j, k + 1, r[1], -s, -r[0]) for k, r in enumerate(fits)]
    return out


@pytest.mark.parametrize("bucket,shard", [(2048, 32768), (16, 64)])
def test_negatives(spark, monkeypatch, bucket, shard):
    """Copies of one vector (a third of all, also over labels), ties, zero vectors, rows that take no part, several shards."""
    monkeypatch.setattr(hard_negatives, "BUCKET", bucket)
    monkeypatch.setattr(hard_negatives, "SHARD", shard)
    rng = np.random.default_rng(bucket)
    make = lambda: [float(x) for x in np.round(rng.normal(size=4) * rng.choice([0.2, 1, 3]), 1)]
    hot = [0.5, 0.25, -0.5, 1.0]
    rows = [(i, hot if i % 3 == 0 else make(), int(rng.integers(0, 3))) for i in range(240)]
    rows += [(300, [0.0] * 4, 1), (301, [0.0] * 4, 2), (302, None, 1), (303, [1.0, None, 1.0, 1.0], 1), (304, [float("nan")] * 4, 1), (305, [float("inf")] * 4, 1), (306, hot, None), (307, [1.0], 1), (308, [], 1), (None, hot, 1)]
    rows += [rows[5], rows[5], (310, [1e30] * 4, 1)]
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id bigint, embedding array<double>, label int, node int, v int, shard int").repartition(3)
    got = hard_negatives.mine(frame, "vec_id % 5 = 0 OR vec_id = 306 OR vec_id = 301")
    want = naive_negatives(rows[:-1], lambda i: i % 5 == 0 or i in (306, 301))
    assert len(want) > 300 and plain(got.collect()) == plain(want)
    assert hard_negatives.mine(frame.limit(0), "true").collect() == []


def test_hot_anchors(spark):
    """More than a thousand anchors with one vector: their join is salted."""
    rows = [(i, [1.0, 0.0, 0.0, 0.0] if i % 3 else [0.9, 0.1 * (i % 50), 0.0, 0.0], i % 2) for i in range(4000)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = hard_negatives.mine(frame, "true", high_pct=100)
    assert got.select("anchor_id").distinct().count() == 4000
    some = {r for r in plain(got.where("anchor_id % 400 = 1").collect())}
    assert some == set(naive_negatives(rows, lambda i: i % 400 == 1, high=100))


def test_no_candidate_is_lost():
    rng = np.random.default_rng(2)
    for _ in range(60):
        d = int(rng.integers(1, 9))
        x = np.floor(256 * rng.normal(size=(100, d)) * rng.choice([0.01, 1, 20])).astype(np.int64)
        b = hard_negatives.Bucket(np.arange(100), np.zeros(100, np.int64), x)
        q = np.floor(256 * rng.normal(size=d)).astype(np.int64)
        size = float(np.sqrt(q.astype(float) @ q))
        if not size:
            continue
        score = x @ q
        for least in (1, int(np.quantile(score, 0.9)), int(score.max()), int(score.max()) + 1):
            found = b.candidates(q / size, size, np.argsort(-np.abs(q))[: hard_negatives.FOCUS], float(least))
            if found is not None:
                assert set(np.flatnonzero(score >= least)) <= set(found.tolist()) and least > 0
                assert (b.scores(q, found) == score[found]).all()


def test_op13(spark):
    got = hard_negatives.op13_hard_negatives(spark, "/root/testdata/sf0.001").collect()
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    v = np.floor(256 * np.array([r["embedding"] for r in rows], dtype=np.float64)).astype(np.int64)
    ids = np.array([r["vec_id"] for r in rows])
    labels = np.array([(r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"] for r in rows])
    want = []
    for a in np.flatnonzero(ids % 50 == 0):
        score = v @ v[a]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[a]]
        for p in [i for i in order if labels[i] == labels[a]][:5]:
            fits = [i for i in order if labels[i] != labels[a] and 50 * score[p] <= 100 * score[i] <= 95 * score[p]][:3]
            want += [(int(ids[a]), int(ids[p]), k + 1, int(ids[i]), int(score[p]), int(score[i])) for k, i in enumerate(fits)]
    assert plain(got) == plain(want)
