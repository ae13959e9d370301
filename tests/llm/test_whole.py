"""What is bounded is the fitting sample only: statistics, texts and rows are taken whole."""

import time
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest

from quirewell.llm import html_extract, language_id, near_dedup, quality, substring_dedup


@pytest.mark.parametrize("query", [quality.op9_quality, lambda s, d: corpus_pipeline.quality_stage(s, s.read.parquet(f"{d}/documents.parquet"), d)])
def test_quality_prior(spark, tmp_path, monkeypatch, query):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join("".join(rng.choice(list("abcdefgh"), 6)) + ("###" if i % 7 == 0 else "") for _ in range(20)), int(i % 7 != 0)) for i in range(700)]
    rows += [(i, None, 0) for i in range(700, 800)]
    spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, q) for i, _, q in rows] + [(i, 0) for i in range(800, 2000)]  # without a document
    labels = spark.createDataFrame(labels, "doc_id bigint, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    trained = {r["doc_id"] for r in labels.where(~quality.held_out(labels["doc_id"], 5, 0)).collect()}
    seen, calibrate = [], quality._calibrate

    def spy(x, y, weight):
        seen.append((weight[y == 1].sum() / weight[y == 0].sum(), len(y)))
        return calibrate(x, y, weight)

    monkeypatch.setattr(quality, "_calibrate", spy)
    monkeypatch.setattr(quality, "SAMPLE_ROWS", 20)
    query(spark, str(tmp_path)).count()
    count = [sum(i in trained and t is not None and q == c for i, t, q in rows) for c in (0, 1)]
    assert seen[0][0] == pytest.approx(count[1] / count[0])


def test_rows_of_one_id(spark):
    """Of rows with one doc_id and different texts only the one decided on changes."""
    copied, own, passage = (" ".join(f"{c}{i}" for i in range(80)) for c in "aou")
    rows = [(1, copied), (1, passage), (2, copied), (2, own), (3, "x " + passage + " y"), (3, own + " z"), (3, "x " + passage + " y"), (None, copied)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    texts = lambda df: sorted(((r[0], r[1]) for r in df.collect()), key=repr)
    got = substring_dedup.deduplicate_substrings(docs, with_text=True).select("doc_id", "kept_text")
    want = [(1, copied), (1, passage), (2, ""), (2, own), (3, "x y"), (3, "z"), (3, "x y"), (None, copied)]
    assert texts(got) == sorted(want, key=repr)
    assert texts(corpus_pipeline.passage_stage(spark, docs, "")) == sorted(want, key=repr)
    left = corpus_pipeline.exact_stage(spark, docs, "")
    assert texts(left) == sorted([r for r in rows if r != (2, copied)], key=repr)


@pytest.mark.parametrize("order", [0, 1, 2])
def test_near_rows_of_one_id(spark, order):
    """Texts that share a doc_id are linked by what they say, in any order of the rows."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(9, a), (9, b), (3, a + " end"), (12, b), (20, c), (None, c)]
    rows = rows[order:] + rows[:order]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(1))
    found = {(r["doc_id"], r["row"]): (r["component_id"], r["kept"]) for r in got.collect()}
    ids = {}
    for (i, _), x in found.items():
        ids.setdefault(i, set()).add(x)
    assert ids == {9: {(3, False), (9, True)}, 3: {(3, True)}, 12: {(9, False)}, 20: {(20, True)}, None: {(None, True)}}
    kept = corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    assert sorted(((r[0] or 0, r[1]) for r in kept.collect())) == sorted([(9, b), (3, a + " end"), (20, c), (0, c)])


@pytest.mark.parametrize("html", ["<div class=a>" * 30_000 + "x", "<a " * 20_000, "</x " * 20_000, "<ul><li>" * 8000 + "y", "<span>" * 20_000 + "</b>" * 20_000, "<p>t</p>" + "<a " * 20_000 + "<!-- x"])
def test_html_without_end(html):
    """Deep nesting and tags that never close take linear time."""
    began = time.process_time()
    page = html_extract.Page(html)
    page.text({page.best()})
    assert time.process_time() - began < 5


def test_smallest(spark):
    """Hash-bounded samples are exactly the rows with the smallest hashes."""
    from quirewell.llm.common import smallest

    rows = spark.range(5000).selectExpr("id AS doc_id", "IF(id % 50 = 0, 'few', 'many') AS lang")
    got = {(r["lang"], r["doc_id"]) for r in smallest(rows, "lang", 120).collect()}
    h = rows.selectExpr("lang", "doc_id", "pmod(xxhash64(doc_id), 1099511627776L) AS h").collect()
    want = {("few", r["doc_id"]) for r in h if r["lang"] == "few"} | {(r["lang"], r["doc_id"]) for r in sorted((r for r in h if r["lang"] == "many"), key=lambda r: r["h"])[:120]}
    assert got == want


COMMENTS = "<div id='comments'><article class='comment'><p>a comment that is longer than the text itself</p></article></div>"


@pytest.mark.parametrize(
    "html,want",
    [
        ("<div class='content-sidebar-wrap'><main><p>the text of the page, of some length</p></main><div class='sidebar'>more</div></div><p>copyright</p>", "the text of the page, of some length"),
        (f"<div class='has-sidebar'><article><p>the text of the page is here, in an article of some length</p></article>{COMMENTS}</div><p>copyright</p>", "the text of the page is here, in an article of some length"),
        ("<div class='has-sidebar'><div><p>the text</p></div><nav>menu</nav></div>", "the text"),
        (f"<article><p>the text</p></article>{COMMENTS}", "the text"),
        ("<div class='content'><p>the text of the page</p></div><div class='related'><article>card</article></div>", "the text of the page"),
    ],
)
def test_layout_wrappers(html, want):
    page = html_extract.Page(f"<html><body>{html}</body></html>")
    assert page.text({page.best()}) == want


def test_fitting_on_whole_texts(spark, monkeypatch):
    rows = [(i, f"{'ab' if i % 2 else 'xy'} {i} " * 3000, "aa" if i % 2 else "zz", i % 2) for i in range(40)]
    rows = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, quality int")
    seen = {"language": [], "quality": []}
    weigh, features = language_id.tf_idf, quality.CompressionModel.features
    monkeypatch.setattr(language_id, "tf_idf", lambda t, idf: seen["language"].append(t) or weigh(t, idf))
    monkeypatch.setattr(quality.CompressionModel, "features", lambda m, d: seen["quality"].append(d.decode()) or features(m, d))
    language_id.fit(rows)
    quality.fit(rows)
    whole = {r["text"] for r in rows.collect()}
    assert set(seen["language"]) == whole
    assert seen["quality"] and set(seen["quality"]) <= whole


def test_pipeline_brute_force(spark, tmp_path):
    """Each stage's rows against a plain version, on planted copies, near copies and passages."""
    from test_edges import naive_components, naive_substrings
    from tokenizers import Tokenizer

    rng = np.random.default_rng(3)
    say = lambda n, mark="": " ".join(f"w{x}{mark}" for x in rng.integers(0, 4000, n))
    texts = [say(120) for _ in range(20)] + [say(60, "###") for _ in range(8)]
    texts += [texts[1], texts[2].replace(" ", "  "), " ".join([*texts[3].split()[:60], "other", *texts[3].split()[61:]])]
    shared = say(55)
    texts += [f"{say(70)} {shared} {say(70)}", f"{say(80)} {shared} {say(60)}", f"{shared} {say(90)}"]
    rows = list(enumerate(texts))
    spark.createDataFrame([(i, int("###" not in t)) for i, t in rows], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    stage = lambda k, rows: sorted(tuple(r) for r in corpus_pipeline.STAGES[k][1](spark, frame(rows), str(tmp_path)).collect())

    labelled, total = quality.labelled_rows(frame(rows), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    model = quality.fit(labelled, total=total)
    got = stage(0, rows)
    assert got == [r for r in rows if model.score(r[1]) >= 0.3]
    best = {}
    for i, t in rows:
        best.setdefault("".join(t.split()), []).append((-len(t), i, t))
    want = sorted((i, t) for _, i, t in map(min, best.values()))
    assert len(want) == len(rows) - 2 and stage(1, rows) == want
    rows = want
    root, _ = naive_components([t for _, t in rows], 5, 80)
    want = [r for k, r in enumerate(rows) if root[k] == k]
    assert len(want) < len(rows) and stage(2, rows) == want
    rows = want
    cut = naive_substrings(rows, 50)
    want = [(i, t if len(cut[i].split()) == len(t.split()) else cut[i].decode()) for i, t in rows]
    assert want != rows and stage(3, rows) == want
    rows = want
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = corpus_pipeline.packing_stage(spark, frame(rows), "").collect()
    for i, text in rows:
        ids, at = [*t.encode(text, add_special_tokens=False).ids, 2], 0
        for r in sorted((r for r in pieces if r["doc_id"] == i), key=lambda r: r["start"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
