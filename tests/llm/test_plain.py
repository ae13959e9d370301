"""Every opN query over the smallest tables against a plain version."""

import html
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import zstandard
from test_edges import naive_components, naive_substrings

from quirewell.llm import bpe, graph_ann, html_extract, language_id, near_dedup, packing, quality, substring_dedup
from quirewell.llm.common import tail_share

DIR = "/root/testdata/sf0.001"
crc = lambda i: zlib.crc32(str(i).encode())


def table(name, *columns):
    t = pq.read_table(f"{DIR}/{name}.parquet", columns=list(columns))
    return list(zip(*(t.column(c).to_pylist() for c in columns), strict=True))


@pytest.fixture(scope="module")
def docs():
    return sorted(table("documents", "doc_id", "text"))


def test_op1(spark, docs):
    root, sizes = naive_components([t for _, t in docs], 2, 80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.op1_minhash(spark, DIR).collect()}
    assert got == {i: (sizes[k], docs[root[k]][0], root[k] == k) for k, (i, _) in enumerate(docs)}
    assert tail_share(64, 80) > 0


def test_op3(spark):
    rows = [(i, np.asarray(v, np.float64)) for i, v in table("embeddings", "vec_id", "embedding") if v is not None]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    got = {}
    for r in graph_ann.op3_ann(spark, DIR).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = 0
    for q in ids[ids % 20 == 0]:
        score = x @ x[ids == q][0]
        best = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:20]
        assert len(got[q]) == 20 and got[q] == sorted(got[q], key=lambda r: (-r[1], r[0]))
        assert all(abs(s - score[ids == i][0]) < 1e-9 for i, s in got[q])
        hits += len({int(ids[j]) for j in best} & {i for i, _ in got[q]})
    assert set(got) == {int(i) for i in ids if i % 20 == 0} and hits >= 0.95 * 20 * len(got)


def test_op5(spark, docs):
    import hashlib

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for i, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[i] = (len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.op5_bpe(spark, DIR).collect()} == want


def test_op7(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: [*t.encode(text or "", add_special_tokens=False).ids, 2] for i, text in docs}
    rows, at, filled = packing.op7_packing(spark, DIR).collect(), {}, {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        ids = want[r["doc_id"]]
        assert r["start"] == at.get(r["doc_id"], 0) and r["doc_tokens"] == len(ids)
        at[r["doc_id"]] = r["start"] + r["length"]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : at[r["doc_id"]]], "<u4").tobytes())
    assert at == {i: len(ids) for i, ids in want.items()}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 4096 and len(filled) <= 1.1 * sum(filled.values()) / 4096 + 1


def test_op8(spark, docs):
    import hashlib

    kept = naive_substrings(docs, 13)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.op8_substring(spark, DIR).collect()}
    for i, text in docs:
        n, left = len((text or "").encode().split()), kept[i]
        assert got[i] == (n, n - len(left.split()), hashlib.sha256(left).hexdigest())


def test_op4(spark, docs):
    """A dense model over the same grams gives the same predictions; held-out documents are told right."""
    rows = {r["doc_id"]: r for r in language_id.op4_language(spark, DIR).collect()}
    lang = dict(table("documents", "doc_id", "lang"))
    train = spark.read.parquet(f"{DIR}/documents.parquet").where("crc32(cast(cast(doc_id AS string) AS binary)) % 3 <> 1")
    model = language_id.fit(train.select("doc_id", "text", "lang"))
    grams = {i: language_id.gram_counts(t) for i, t in docs if t}
    own = [i for i in grams if crc(i) % 3 != 1 and lang[i] is not None]
    df = sum((grams[i] > 0).astype(int) for i in own)
    assert np.allclose(model.idf, np.log((1 + len(own)) / (1 + df)) + 1)
    right = []
    for i, text in docs:
        r = rows[i]
        assert r["held_out"] == (crc(i) % 3 == 1)
        if not any(c.isalpha() for c in text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        x = np.where(grams[i] > 0, 1 + np.log(np.maximum(grams[i], 1)), 0) * model.idf
        z = (x / np.sqrt((x * x).sum()) @ model.weights.astype(np.float64) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert r["lang_pred"] == model.languages[int(p.argmax())] and abs(r["score"] - p.max()) < 1e-4
        right += [r["lang_pred"] == lang[i]] if r["held_out"] and lang[i] is not None else []
    assert np.mean(right) > 0.97


def test_leader_is_the_dense_one(monkeypatch):
    """Sparse follow-the-regularised-leader against the formulas on dense vectors."""
    monkeypatch.setattr(language_id, "BITS", 4)
    rng = np.random.default_rng(3)
    rows = []
    for y in rng.integers(0, 3, 60):
        at = np.sort(rng.choice(16, 4, replace=False))
        rows.append((at, rng.random(4) + (at % 3 == y), int(y)))
    w, b = language_id.follow_the_leader(rows, 3)
    z, n, zb, nb = np.zeros((16, 3)), np.zeros((16, 3)), np.zeros(3), np.zeros(3)
    A, BETA, L1, L2 = language_id.ALPHA, language_id.BETA, language_id.L1, language_id.L2
    leader = lambda z, n, l1: np.where(abs(z) <= l1, 0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / A + L2))
    order = np.random.default_rng(7)
    for _ in range(language_id.EPOCHS):
        for i in order.permutation(len(rows)):
            x = np.zeros(16)
            x[rows[i][0]] = rows[i][1]
            now, nowb = leader(z, n, L1), leader(zb, nb, 0)
            p = np.exp(x @ now + nowb)
            p = p / p.sum() - np.eye(3)[rows[i][2]]
            g = np.outer(x, p)
            z, n = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / A * now, n + g * g
            zb, nb = zb + p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / A * nowb, nb + p * p
    assert np.allclose(w, leader(z, n, L1)) and np.allclose(b, leader(zb, nb, 0))


def test_op9(spark, docs):
    """Each text compressed by hand with the fitted dictionaries; whole, empty and null texts."""
    got = {r["doc_id"]: r for r in quality.op9_quality(spark, DIR).collect()}
    rows, total = quality.labelled_rows(spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet"))
    label = {i: q for i, q in table("labels", "doc_id", "quality") if q is not None}
    trained = [i for i in label if crc(i) % 5 != 0]
    assert total == {q: sum(label[i] == q for i in trained) for q in (0, 1)}
    assert {r["doc_id"] for r in rows.collect()} == set(trained)
    model = quality.fit(rows, total=total)

    def size(data, dictionary):
        c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_dict_id=False)
        return sum(len(c.compress(data[s : s + 2048])) for s in range(0, len(data), 2048))

    right = []
    for i, text in docs:
        data = (text or "").encode()
        if data:
            g, b = size(data, model.good), size(data, model.bad)
            x, rate = (b - g) / (b + g), np.log(min(b, g) / len(data))
        else:
            x, rate = 0.0, model.usual_rate
        score = 1 / (1 + np.exp(-(model.weights[0] * x + model.weights[1] * rate + model.weights[2])))
        r = got[i]
        assert abs(r["score"] - score) < 1e-9 and r["predicted"] == int(score >= 0.3) and r["held_out"] == (crc(i) % 5 == 0)
        right += [r["predicted"] == label[i]] if r["held_out"] and i in label else []
    assert len(right) > 5 and np.mean(right) > 0.8


def page(rng, host, n):
    """A page of one of three layouts, and its main text."""
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvéß漢") for _ in range(rng.randint(2, 9)))
    say = lambda k: " ".join(word() for _ in range(k))
    blocks = [say(rng.randint(25, 60)) + " & <b>  x" for _ in range(rng.randint(3, 6))]
    head = say(4)
    entity = lambda t: html.escape(t).replace("é", "&eacute;").replace(" ", "&nbsp;")
    body = "".join(f"<p>\n  {entity(b).replace(' ', rng.choice([' ', chr(10) + '  ']), 3)} </p>" for b in blocks)
    links = "".join(f"<li><a href='/{i}'>{say(2)}</a></li>" for i in range(8))
    article = {0: f"<main><article class='post'><h1>{head}</h1>{body}</article></main>", 1: f"<div id='wrap'><div class='story-body'><h1>{head}</h1>{body}</div></div>", 2: f"<table><tr><td class='entry'><h1>{head}</h1>{body}</td></tr></table>"}[host]
    around = f"<nav><ul>{links}</ul></nav><header>{say(5)}</header>", f"<aside class='sidebar'><p>{say(20)}</p></aside><div class='ad'>{say(8)}</div><div id='comments'><p>{say(30)}</p></div><form>{say(3)}<input></form><footer><p>{say(12)}</p></footer><script>var x = '<p>{say(3)}</p>';</script>"
    text = " ".join(" ".join(b.split()) for b in [head, *blocks])
    return f"<!DOCTYPE html><html><head><title>{say(3)}</title><style>p {{}}</style></head><body>{around[0]}{article}{around[1]}</body></html>", text


def test_op2(spark, tmp_path):
    """Pages of known text on three hosts, some of them twice, null and empty ones."""
    rng = random.Random(6)
    rows, want = [], {}
    for i in range(45):
        source, text = page(rng, i % 3, i)
        rows.append((i, f"https://host{i % 3}.example/{i}", source))
        want[i] = text
    rows += [(100, "https://host0.example/x", None), (101, None, ""), (102, "https://host1.example/1", rows[1][2]), (103, "", "<p>only this</p>")]
    want |= {100: "", 101: "", 102: want[1], 103: "only this"}
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.op2_html(spark, str(tmp_path)).collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_op2_hot_host(spark):
    """Thousands of paths of one host: only winners are gathered."""
    rows = [("hot", f"div.p{i}") for i in range(20_000)] + [("hot", "article")] * 3000 + [("cold", "main")] * 2 + [("cold", "div")]
    got = {r["host"]: r["paths"] for r in html_extract.winners(spark.createDataFrame(rows, "host string, path string").repartition(8)).collect()}
    assert got == {"hot": ["article"], "cold": ["main", "div"]}


def test_packing_null_ids(spark):
    """Pieces of null ids with one text are ranked in many blocks."""
    docs = spark.createDataFrame([(None, "one two three")] * 3000 + [(1, "one")], "doc_id bigint, text string").repartition(4)
    cuts = packing.cut(docs, public_tokenizers.path("word_bpe_49k.json"), 4096, 2, False)
    assert cuts.where("doc_id IS NULL").select("spread").distinct().count() > 300
    rows = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert len(rows) == 3001 and "spread" not in rows[0].asDict()
    filled = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
