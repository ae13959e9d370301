"""The persisted index against plain BM25: blocks, deltas, compaction, lost writes."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from quirewell.operators import retrieval, search_index
from quirewell.operators.search_index import SearchIndex, fold
from quirewell.sources import folders


def plain(docs, terms, most=None):
    """Best documents by BM25, as (id, score)."""
    held = {i: Counter(re.findall(r"[^\W_]+", fold(t or ""))) for i, t in docs.items()}
    size = {i: sum(c.values()) for i, c in held.items()}
    mean, n = sum(size.values()) / len(size), len(held)
    df = {t: sum(t in c for c in held.values()) for t in terms}
    out = []
    for i, c in held.items():
        if any(t in c for t in terms):
            out.append((i, sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * size[i] / mean)) for t in terms if t in c)))
    return sorted(out, key=lambda r: (-r[1], r[0]))[:most]


def same(found, want):
    got = sorted(((r["id"], r["score"]) for r in found.collect()), key=lambda r: (-r[1], r[0]))
    assert [i for i, _ in got] == [i for i, _ in want]
    assert np.allclose([x for _, x in got], [x for _, x in want], atol=1e-9)


@pytest.fixture
def texts():
    rng = np.random.default_rng(5)
    docs = {f"d{i:03}": " ".join(f"w{int(x)}" for x in np.minimum(rng.zipf(1.4, rng.integers(1, 60)), 30)) for i in range(300)}
    return {**docs, "e1": "Été w3", "e2": None, "e3": "***", "e4": "eté ÎLE"}


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "id string, text string")


def test_match(spark, texts, monkeypatch):
    monkeypatch.setattr(search_index, "BLOCK", 20)
    index = SearchIndex.build(frame(spark, texts), folders.work_folder(spark), "id", ("text",), buckets=3)
    for terms, most in ((["w1", "w7"], None), (["w1", "w2", "w25"], 5), (["w1"], 10), (["w29", "w3"], 1000), (["été"], 5), (["ile", "w1"], 7)):
        same(index.match(terms, most), plain(texts, list(map(fold, terms)), most))
    assert index.match(["nowhere"], 5) is None and index.match([], 5) is None
    only = spark.createDataFrame([("d001",), ("d100",), ("e1",)], "id string")
    same(index.match(["w3", "w1"], 5, only), [r for r in plain(texts, ["w3", "w1"]) if r[0] in ("d001", "d100", "e1")])


def test_early_end(spark, monkeypatch):
    """Blocks that can't hold one of the best are not read."""
    texts = {f"d{i:03}": "w1 " + "pad " * i for i in range(200)}
    monkeypatch.setattr(search_index, "BLOCK", 10)
    index = SearchIndex.build(frame(spark, texts), folders.work_folder(spark), "id", ("text",))
    seen = []
    reach = SearchIndex._reachable
    monkeypatch.setattr(SearchIndex, "_reachable", staticmethod(lambda p, *a: seen.append((p.count(), (q := reach(p, *a)).count())) or q))
    same(index.match(["w1"], 3), plain(texts, ["w1"], 3))
    assert seen[0][0] == 20 and seen[0][1] <= 2


def test_generations(spark, texts):
    path = folders.work_folder(spark)
    index = SearchIndex.build(frame(spark, texts), path, "id", ("text",), buckets=4)
    new = {"d001": "w1 w1 fresh", "d002": "other", "n1": "w1 fresh fresh"}
    gone = spark.createDataFrame([("d003",), ("e1",)], "id string")
    index.update(frame(spark, new), gone, "id", ("text",))
    now = {**{i: t for i, t in texts.items() if i not in ("d003", "e1")}, **new}
    same(index.match(["w1", "fresh"], 20), plain(now, ["w1", "fresh"], 20))
    index.update(frame(spark, {"d001": "back w2"}), gone.limit(0), "id", ("text",))
    now["d001"] = "back w2"
    same(SearchIndex(spark, path).match(["w1", "fresh", "back"], 20), plain(now, ["w1", "fresh", "back"], 20))
    before = sorted(map(tuple, index.entries().collect()))
    index.compact()
    assert len(index.manifest()) == 1 and sorted(map(tuple, index.entries().collect())) == before
    same(index.match(["w1", "fresh", "back"], 20), plain(now, ["w1", "fresh", "back"], 20))


def test_lost_write(spark, texts, monkeypatch):
    """A generation that was not finished doesn't count, and is written anew."""
    path = folders.work_folder(spark)
    index = SearchIndex.build(frame(spark, texts), path, "id", ("text",))
    new, none = frame(spark, {"n1": "w1 w1"}), spark.createDataFrame([], "id string")
    delete = folders.delete
    monkeypatch.setattr(folders, "delete", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        index.update(new, none, "id", ("text",))
    monkeypatch.setattr(folders, "delete", delete)
    same(index.match(["w1"], 9), plain(texts, ["w1"], 9))
    index.update(new, none, "id", ("text",))
    same(index.match(["w1"], 9), plain({**texts, "n1": "w1 w1"}, ["w1"], 9))


def test_empty(spark):
    none = spark.createDataFrame([], "id string, text string")
    index = SearchIndex.build(none, folders.work_folder(spark), "id", ("text",))
    assert index.match(["a"], 3) is None and index.docs().count() == 0


def test_books_are_chosen_after_candidates(spark):
    """A book without a match has nothing if another book has one; without any match the first notes are scored."""
    rows = [("a1", "highlight", "x", "T", "", "some lexeme here"), ("b1", "highlight", "y", "T", "", "about lexemes"), ("b2", "thought", "y", "T", "", "none")]
    notes = spark.createDataFrame(rows, "note_id string, note_type string, book_id string, title string, chapter string, content string")
    index = SearchIndex.build(notes, folders.work_folder(spark), "note_id", ("title", "chapter", "content"))
    ids = lambda q, **k: [r["note_id"] for r in retrieval.hybrid_search(notes, index, q, 20, **k).collect()]
    assert ids("lexeme") == ["a1"] and ids("lexeme", book_ids=["y"]) == []
    assert ids("exeme") == ["a1", "b1"] and ids("exeme", book_ids=["y"]) == ["b1"]
    assert ids(" ", book_ids=["y"]) == ["b1", "b2"] and ids(" ", kind="thought") == ["b2"]
    assert ids("lexeme", kind="thought") == []
