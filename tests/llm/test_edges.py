"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest

from quirewell.llm import bpe, exact_dedup, graph_ann, html_extract, language_id, near_dedup, packing, quality, substring_dedup, warc
from quirewell.llm.common import work_dir

SCHEMA = "doc_id bigint, text string, lang string, size int, digest string, node bigint, component string, value int, rank int, n int"
LONG = " ".join(f"w{i}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "d", 2, "c", 3, 4, 5) for i, t, lang in rows], SCHEMA)


ROWS = [(1, None, "en"), (2, "", None), (3, " \t\n", "en"), (4, "one", "en"), (5, "one", "de"), (6, LONG, "en"), (7, LONG + " end", "en"), (8, "b c d e f g", None), (8, "b c d e f g", None), (None, "one", "en"), (9, "***", "de"), (10, "x " + PASSAGE + " y", "en"), (11, "z " + PASSAGE, "en")]


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_exact(spark):
    got = by_id(exact_dedup.decide(docs(spark, ROWS)))
    assert [r["kept"] for r in got[1]] == [False] and got[1][0]["keep_id"] == 3  # blanks: the longest stays
    assert got[3][0]["kept"] and got[4][0]["group_size"] == 3 and got[5][0]["keep_id"] == 4
    assert not got[None][0]["kept"] and [r["kept"] for r in got[8]] == [True, True]
    assert exact_dedup.decide(docs(spark, ROWS).limit(0)).count() == 0


def test_exact_index_grows(spark):
    index = exact_dedup.DigestIndex.create(spark, work_dir(spark), buckets=2)
    exact_dedup.decide(docs(spark, [(1, "a", None), (2, "b", None)]), index).collect()
    got = by_id(exact_dedup.decide(docs(spark, [(3, "a ", None), (4, "c", None)]), index))
    assert (got[3][0]["keep_id"], got[3][0]["kept"], got[4][0]["kept"]) == (1, False, True)
    assert index.read().count() == 3


def test_exact_batch_again(spark):
    """A batch whose result was lost after the index had grown, in whole or in part, is decided alike."""
    from pyspark.sql import functions as F

    home = work_dir(spark)
    index = exact_dedup.DigestIndex.create(spark, home, buckets=2)
    batch = docs(spark, [(1, "a", None), (2, "b", None), (3, "a", None), (None, "c", None)])
    flags = lambda df: sorted(((r["doc_id"] or 0, r["kept"]) for r in df.collect()))
    want = [(0, True), (1, True), (2, True), (3, False)]
    assert flags(exact_dedup.decide(batch, index)) == want
    assert flags(exact_dedup.decide(batch.repartition(3), index)) == want and index.read().count() == 3
    later = docs(spark, [(1, "a", None), (4, "b", None), (5, "d", None)])
    assert flags(exact_dedup.decide(later, index)) == [(1, False), (4, False), (5, True)]
    assert flags(exact_dedup.decide(later, index)) == [(1, False), (4, False), (5, True)]
    assert flags(exact_dedup.decide(batch, index)) == want
    # only some of the digests had been written when the batch was lost
    part = exact_dedup.DigestIndex.create(spark, work_dir(spark), buckets=2)
    part.append(batch.where("doc_id = 1").select(exact_dedup.digest(F.col("text")).alias("digest"), F.lit(1).cast("bigint").alias("keep_id"), F.lit(2).cast("bigint").alias("group_size")), "monday")
    assert flags(exact_dedup.decide(batch, part, batch="monday")) == want
    assert flags(exact_dedup.decide(batch, part, batch="tuesday")) == [(0, False), (1, False), (2, False), (3, False)]


def test_near(spark):
    got = by_id(near_dedup.near_duplicates(docs(spark, ROWS)))
    assert got[1][0]["n_shingles"] == got[3][0]["n_shingles"] == 0 and got[3][0]["kept"]
    assert got[5][0]["component_id"] == 4 and got[7][0]["component_id"] == 6
    assert got[None][0]["component_id"] is None and got[None][0]["kept"]
    assert near_dedup.near_duplicates(docs(spark, ROWS).limit(0)).count() == 0


def naive_components(texts, size, pct):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= pct * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))], [len(s) for s in sets]


@pytest.mark.parametrize("size,block,k", [(2, 128, 64), (5, 4, 64), (2, 3, 1000), (2, 4, 16)])
def test_near_is_exhaustive(spark, monkeypatch, size, block, k):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "CELLS", 1000)
    rng = np.random.default_rng(size)
    texts = []
    for _ in range(12):
        base = [f"v{x}" for x in rng.integers(0, 400, int(rng.integers(3, 160)))]
        for _ in range(int(rng.integers(1, 9))):
            t = list(base)
            for _ in range(int(rng.integers(0, 1 + len(t) // 12))):
                t[int(rng.integers(len(t)))] = f"V{rng.integers(400)}"
            texts.append(" ".join(t))
    got = by_id(near_dedup.near_duplicates(docs(spark, [(i, t, None) for i, t in enumerate(texts)]), shingle=size, k=k))
    want, sizes = naive_components(texts, size, 80)
    assert [got[i][0]["component_id"] for i in range(len(texts))] == want
    assert [got[i][0]["n_shingles"] for i in range(len(texts))] == sizes


def naive_substrings(rows, window):
    first, out = {}, {}
    for i, t in sorted((i, t) for i, t in rows):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first.setdefault(tuple(w[j : j + window]), i) < i:
                gone[j : j + window] = [True] * window
        out[i] = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
    return out


@pytest.mark.parametrize("window,shard", [(13, 20_000), (4, 20_000), (4, 40), (4, 12)])
def test_substrings(spark, monkeypatch, window, shard):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", shard)
    rng = np.random.default_rng(window)
    passages = [" ".join(f"q{x}" for x in rng.integers(0, 9, 30)) for _ in range(4)]
    rows = [(i, " ".join(passages[int(rng.integers(4))] if rng.random() < 0.3 else f"u{rng.integers(50)}" for _ in range(25))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, rows[0][1]), (103, "a b")]
    got = by_id(substring_dedup.deduplicate_substrings(docs(spark, [(i, t, None) for i, t in rows]), window=window))
    for i, kept in naive_substrings(rows, window).items():
        assert got[i][0]["kept_sha256"] == hashlib.sha256(kept).hexdigest(), i
    assert substring_dedup.deduplicate_substrings(docs(spark, ROWS).limit(0)).count() == 0


def test_substring_edges(spark):
    got = by_id(substring_dedup.deduplicate_substrings(docs(spark, ROWS), with_text=True))
    assert got[11][0]["n_removed"] == 60 and got[11][0]["kept_text"] == "z" and got[10][0]["n_removed"] == 0
    assert got[7][0]["kept_text"] == "end" and got[None][0]["n_removed"] == 0 and len(got[8]) == 2


def test_bpe(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, odd = Tokenizer.from_file(path), [(20, "a<|endoftext|>b  c\n d", None), (21, "é漢字😀 it's x", None), (22, " " * 50, None)]
    got = by_id(bpe.encode_digests(docs(spark, ROWS + odd), path))
    for i, text, _ in ROWS + odd:
        ids = t.encode(text or "", add_special_tokens=False).ids
        r = got[i][0]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode_ids(bpe.encode_ids(docs(spark, odd), path), path)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: x for i, x, _ in odd}


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = packing.pack(docs(spark, ROWS), path, with_ids=True).collect()
    pieces, sequences = {}, {}
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"])
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for i, text, _ in ROWS:
        want = t.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted((r for r in pieces[i]), key=lambda r: r["start"])
        if i != 8:  # twice
            assert [x for r in own for x in r["ids"]] == want and {r["doc_tokens"] for r in own} == {len(want)}
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    assert packing.pack(docs(spark, ROWS).limit(0), path).count() == 0


def test_cutting_stock():
    rng = np.random.default_rng(1)
    lengths = np.minimum(rng.lognormal(6, 1, 4000).astype(int) + 1, 4096)
    values, counts = np.unique(lengths, return_counts=True)
    sizes = packing.classes(values, counts, 64, 16)
    assert (sizes * 16 >= values).all() and len(set(sizes)) <= 64
    histogram = {int(s): int(counts[sizes == s].sum()) for s in set(sizes)}
    runs = packing.plan(histogram, 256)
    used = {}
    for r in runs.itertuples():
        for k in range(r.hi - r.lo):
            seq = r.first + k // r.each
            used[seq] = used.get(seq, 0) + r.size
    assert max(used.values()) <= 256
    assert len(used) <= 1.06 * sum(s * n for s, n in histogram.items()) / 256 + 1


def test_language(spark):
    rng = np.random.default_rng(0)
    say = lambda letters: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(30))
    train = [(100 + i, say("abcde") if i % 2 else say("vwxyz"), "aa" if i % 2 else "zz") for i in range(60)]
    model = language_id.fit(docs(spark, train + ROWS[:3]))
    got = by_id(language_id.identify(docs(spark, ROWS + [(50, say("abcde"), None), (51, say("vwxyz"), "aa")]), model))
    assert (got[50][0]["lang_pred"], got[51][0]["lang_pred"]) == ("aa", "zz")
    assert all(got[i][0]["lang_pred"] == "und" and got[i][0]["score"] == 0 for i in (1, 2, 3, 9))
    assert all(0 <= r["score"] <= 1 for x in got.values() for r in x) and len(got[8]) == 2
    empty = language_id.fit(docs(spark, []).limit(0))
    assert by_id(language_id.identify(docs(spark, ROWS), empty))[4][0]["lang_pred"] == "und"


def test_quality(spark):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    labelled = [(i, " ".join(word() + ("###" if i % 4 == 0 else "") for _ in range(80)), int(i % 4 != 0)) for i in range(200)]
    model = quality.fit(spark.createDataFrame(labelled + [(900, None, 1), (901, "x", None)], "doc_id bigint, text string, quality int"))
    fresh = [(500, " ".join(word() for _ in range(80)), None), (501, " ".join(word() + "###" for _ in range(80)), None)]
    got = by_id(quality.classify(docs(spark, ROWS + fresh), model))
    assert got[500][0]["predicted"] == 1 and got[501][0]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 for x in got.values() for r in x) and len(got) == 14
    assert quality.keep_good(docs(spark, fresh), model).columns == docs(spark, fresh).columns
    one = quality.fit(spark.createDataFrame([(1, "a", 1)], "doc_id bigint, text string, quality int"))
    assert by_id(quality.classify(docs(spark, ROWS), one))[2][0]["score"] > 0.5


def test_ann(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)) * rng.uniform(0.5, 2, (300, 1))
    x[100:140] = x[7]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] + [1.0] * 7), (1060, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + bad], "vec_id bigint, embedding array<double>, node int, score int")
    got = {}
    for r in graph_ann.nearest(df, "vec_id % 20 = 0", shard_size=64).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 300, 20))
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(300), -s))[:20]
        hits += len(set(want) & {v for v, _ in found})
        assert len(found) == 20 and found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert all(abs(s[v] - score) < 1e-12 for v, score in found)
    assert hits >= 0.95 * 20 * len(got)
    assert graph_ann.nearest(df.limit(0), "true").count() == 0
    few = graph_ann.nearest(df.where("vec_id IN (0, 3)"), "vec_id % 20 = 0").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in few] == [(0, 1, 3)]


PAGE = "<html><body><nav><a href=/>menu</a></nav><div class='ad'>buy</div><article><h1>A title</h1><p>First &amp; second<br>line<p><b>bold</b>er text of the article, long enough</article><div class=comments><p>nice</div><footer>foot</footer><script>if (a < b) '</p>'</script></body></html>"


def test_html(spark):
    rows = [(1, "http://h.example/1", PAGE), (2, "http://h.example/2", None), (3, None, "just text"), (4, "http://h.example/4", ""), (5, "no url", "<p>a<p>b"), (5, "no url", "<p>a<p>b"), (None, "http://h.example/6", PAGE.replace("First", "Other"))]
    got = html_extract.extract(spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, host string, path string")).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert text[1] == "A title First & second line bolder text of the article, long enough"
    assert (text[2], text[3], text[4], text[5]) == ("", "just text", "", "a b") and len(got) == 7
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_extract.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_warc(spark):
    long = "ü" * 3_000_000
    rows = [(3, "http://a/ b\r\nx", "same"), (1, None, "same"), (2, "http://c", None), (4, "http://d", ""), (5, "http://e", long), (6, "http://f", "same"), (7, "http://g", "é"), (7, "http://g", "é"), (None, "http://h", "same")]
    folder = work_dir(spark)
    manifest = warc.write_archives(spark.createDataFrame([(*r, 1, "s") for r in rows], "page_id bigint, url string, html string, size int, sha string"), folder)
    got = warc.read_archives(manifest, folder).collect()
    assert len(got) == len(rows)
    kind = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in got}
    assert kind[1] == ("response", None) and kind[3] == kind[6] == kind[None] == ("revisit", 1)
    assert kind[2] == ("response", None) and kind[4] == ("revisit", 2) and kind[7] == ("response", None)
    for r in got:
        payload = next(h or "" for i, _, h in rows if i == r["page_id"]).encode()
        assert r["payload_bytes"] == len(payload) and r["payload_digest"] == warc.payload_digest(payload)
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    other = work_dir(spark)
    assert warc.read_archives(warc.write_archives(empty, other), other).count() == 0
