"""Operators on small inputs."""

import random
from collections import Counter

from pyspark.sql import functions as F

from quirewell.functions import text as T
from quirewell.operators import glossary as Y
from quirewell.operators import graph as G
from quirewell.operators import ingest as I
from quirewell.operators import library as L
from quirewell.operators import retrieval as R
from quirewell.operators import search as S


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_terms():
    assert R.search_terms("Ab cd") == ["ab", "bc", "cd"]
    assert R.search_terms("***") == []


def test_text_functions(spark):
    assert one(spark, T.bigrams(F.col("t")), t="abab") == ["ab", "ba"]
    assert one(spark, T.bigrams(F.col("t")), t="a") == []
    assert one(spark, T.char_pairs(F.col("t")), t="a😀b") == ["a😀", "😀b"]
    assert one(spark, T.occurrences(F.col("t"), "ab"), t="ababababab") == 4
    assert one(spark, T.wiki_title(F.col("t")), t="  éa__b ") == "Éa b"
    assert one(spark, T.page_url(F.col("t"), "u/"), t="a b*~é") == "u/a_b%2A~%C3%A9"
    assert one(spark, T.core_title(F.col("t")), t="Name（x）") == "Name"


def test_redirects(spark):
    pages = spark.createDataFrame([(1, 2), (2, 3), (3, None), (4, 5), (5, 4), (6, 6), (7, 99)] + [(100 + i, 101 + i) for i in range(20)] + [(120, None)], "page_id int, target int")
    got = {r["page_id"]: r["outcome"] for r in I.resolve_redirects(pages).collect()}
    assert (got[1], got[2], got[4], got[6], got[7]) == ("ok", "ok", "loop", "loop", "broken")
    assert got[100] == "too_deep" and got[119] == "ok"
    deep = {r["page_id"]: r["outcome"] for r in I.resolve_redirects(pages, 30).collect()}
    assert deep[100] == "ok"


def test_chunks():
    assert I.chunk_text("") == []
    text = "x" * 3000
    assert [len(c) for c in I.chunk_text(text)] == [1200, 1200, 900]
    assert I.chunk_text("a" * 300 + "\n" + "b" * 100)[0] == "a" * 300


def test_upsert_keeps_details(spark):
    old = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "k string, v string, n int")
    new = spark.createDataFrame([("a", None, 5), ("c", "z", 3)], "k string, v string, n int")
    assert sorted(map(tuple, L.merge_upsert(old, new, ["k"]).collect())) == [("a", "x", 5), ("b", "y", 2), ("c", "z", 3)]


def test_degree_cap(spark):
    e = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.8), ("b", "c", 0.7)], "a string, b string, score double")
    assert {(r["a"], r["b"]) for r in G.degree_cap(e, 1).collect()} == {("a", "b")}


def test_degree_cap_is_the_scan(spark):
    rng = random.Random(3)
    rows = [(f"n{a}", f"n{b}", rng.randint(0, 9) / 10) for a in range(30) for b in range(a + 1, 30) if rng.random() < 0.5]
    for cap in (1, 3, 40):
        used, want = Counter(), []
        for a, b, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
            if used[a] < cap and used[b] < cap:
                used.update([a, b])
                want.append((a, b, s))
        assert sorted(map(tuple, G.degree_cap(spark.createDataFrame(rows, "a string, b string, score double"), cap).collect())) == sorted(want)
    assert G.degree_cap(spark.createDataFrame([], "a string, b string, score double"), 2).count() == 0


def test_unknown_sort():
    import pytest

    with pytest.raises(ValueError):
        L.book_page(None, sort_by="nothing")


def test_reader_id(spark):
    import hashlib

    def plain(book):
        md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
        parts = [f"{int(book[i : i + 9]):x}" for i in range(0, len(book), 9)] if book.isdigit() else ["".join(f"{ord(c):x}" for c in book)]
        out = md5(book)[:3] + ("3" if book.isdigit() else "4") + "2" + md5(book)[-2:] + "g".join(f"{len(p):02x}{p}" for p in parts)
        out += md5(book)[: max(0, 20 - len(out))]
        return out + md5(out)[:3]

    for book in ("22806910", "1234567890123", "CB_a1", "书é"):
        assert one(spark, T.reader_id(F.col("t")), t=book) == plain(book), book


def test_titles(spark):
    keys = {"三体（全集）第2部": "体", "《红楼梦》典藏版": "红楼梦", "《红楼梦》": "红楼梦", "三体2：黑暗森林": "体黑暗森林", "The Book (Vol. 3)": "thebookvol", "全三册": "全", "—_·": ""}
    for title, key in keys.items():
        assert one(spark, T.title_key(F.col("t")), t=title) == key, title
    spaces = {"中 文 a b。 是": "中文 a b。是", "end 。": "end。", "書 \uf900": "書\uf900", "\u3400 \U00020001": "\u3400\U00020001", "a 是 b": "a 是 b", "《 是 》": "《是》"}
    for text, clean in spaces.items():
        assert one(spark, T.clean_cjk_space(F.col("t")), t=text) == clean, text


def test_terms_of_a_column(spark):
    texts = ["Ab cd", "***", "", "清史 的 书", "één a", "x"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", R.terms_of(F.col("t")).alias("x")).collect()
    assert {r["t"]: sorted(r["x"]) for r in got} == {t: sorted(R.search_terms(t)) for t in texts}
    assert all([len(x) for x in r["x"]] == sorted((len(x) for x in r["x"]), reverse=True) for r in got)


def test_same_works(spark):
    rng = random.Random(4)
    keys = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(2000)]
    n = Counter(k for k in keys if len(k) >= 4)
    want = {(a, b, n[a], n[b]) for a in n for b in n if a < b and (a in b or b in a)}
    frame = spark.createDataFrame([(k,) for k in keys], "key string")
    assert set(map(tuple, G.same_works(frame).collect())) == want and want
    plan = G.same_works(frame)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_metadata_edges(spark):
    rows = [("a", [" X", "y"], ["s1", "S2 ", "s3"], ["T"]), ("b", ["x"], ["s1", "s2"], ["t", " "]), ("c", None, ["s2"], []), ("d", ["x ", "X"], None, None)]
    meta = spark.createDataFrame(rows, "book_id string, authors array<string>, subjects array<string>, translators array<string>")
    got = {(r["a"], r["b"], r["kind"]): (r["score"], r["labels"]) for r in G.metadata_edges(meta).collect()}
    assert got == {
        ("a", "b", "author"): (0.94, ["x"]), ("a", "d", "author"): (0.94, ["x"]), ("b", "d", "author"): (0.94, ["x"]), ("a", "b", "translator"): (0.9, ["t"]),
        ("a", "b", "subject"): (0.64, ["s1", "s2"]), ("a", "c", "subject"): (0.56, ["s2"]), ("b", "c", "subject"): (0.56, ["s2"]),
    }


def test_author_edges_leave_one_work_out(spark):
    books = spark.createDataFrame([("a", "红楼梦", "x"), ("b", "《红楼梦》典藏版", "x"), ("c", "西游记", "x"), ("d", "西游记", " ")], "book_id string, title string, author string")
    assert {(r["a"], r["b"]) for r in G.author_edges(books).collect()} == {("a", "c"), ("b", "c")}


def test_intro_edges(spark):
    rng = random.Random(5)
    texts = {f"b{i:02}": "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(30, 60))) for i in range(25)}
    sets = {k: {t[i : i + 2] for i in range(len(t) - 1)} for k, t in texts.items() if len(t) >= 40}
    n = Counter(g for s in sets.values() for g in s)
    want = set()
    for a in sets:
        for b in sets:
            shared = sum(2 <= n[g] <= 9 for g in sets[a] & sets[b])
            score = shared / (len(sets[a]) * len(sets[b])) ** 0.5
            if a < b and shared >= 3 and score >= 0.05:
                want.add((a, b, shared, round(min(0.92, score), 6)))
    got = G.intro_edges(spark.createDataFrame(list(texts.items()), "book_id string, description string"), 3, 0.05, 9)
    assert set(map(tuple, got.collect())) == want and want


def test_fuzzy_best(spark):
    wanted = spark.createDataFrame([(1, "Book: one", "Ann"), (2, "", "Ann"), (3, "Other", "Bob"), (4, "Nothing", "")], "id int, title string, author string")
    found = spark.createDataFrame([(1, 1, "Book", "x"), (1, 2, "Book (2)", "Ann Lee"), (2, 3, "Any", "Ann"), (2, 4, None, "q"), (3, 5, "Unlike", "bob!"), (3, 6, "Unlike", "Bob"), (4, 7, "Some", "z")], "id int, key int, title string, author string")
    assert {tuple(r) for r in S.fuzzy_best(wanted, found).collect()} == {(1, 2, 120), (2, 4, 100), (3, 6, 20)}
    assert {tuple(r) for r in S.fuzzy_best(wanted, found, "abstract").collect()} == {(1, 2, 130), (2, 4, 100)}


TERM = "id int, term string, canonical_name string, aliases array<string>, definition string, source string, status string, manually_edited boolean, updated_at bigint"


def test_glossary_edits(spark):
    import pytest

    terms = spark.createDataFrame([(1, "a", "A", ["x"], "d", "manual", "pending", False, 1)], TERM)
    edit = lambda *rows: spark.createDataFrame([(*r, ["m"], "") for r in rows], "id int, term string, canonical_name string, definition string, status string, seq int, aliases array<string>, source string")
    got = Y.save(terms, edit((1, "a", "A", "d1", "", 1), (1, "b", "A", "d2", "ignored", 2), (0, "new", "", "n1", "", 1), (9, "new", "", "n2", "", 2), (0, "a", "A", "by term", "", 0)), F.lit(5).cast("bigint"))
    assert sorted((r["id"], r["term"], r["definition"], r["status"]) for r in got.collect()) == [(1, "b", "d2", "ignored"), (2, "new", "n2", "confirmed")]
    with pytest.raises(ValueError):
        Y.save(terms, edit((1, "a", "A", "d", "nonsense", 1)), F.lit(5).cast("bigint"))


def test_named_pairs(spark, monkeypatch):
    terms = spark.createDataFrame([(i, t) for i, t in enumerate(["ab", "b", "ab", "cde", "", "zz", "d"])], "term_id int, term string")
    texts = spark.createDataFrame([("x", "ABcde"), ("y", None), ("z", ""), ("w", "bb b")], "id string, text string").repartition(2)
    want = {("x", 0), ("x", 1), ("x", 2), ("x", 3), ("x", 6), ("w", 1)}
    for size in (4 << 20, 40):
        monkeypatch.setattr(Y, "AUTOMATON_BYTES", size)
        got = [tuple(r) for r in Y.named_pairs(texts, terms, "id", "text").collect()]
        assert len(got) == len(want) and set(got) == want
    assert Y.named_pairs(texts, terms.limit(0), "id", "text").count() == 0


def test_browse(spark):
    import pytest

    books = spark.createDataFrame([("b1", "Title", "An", "cat", 5, False), ("b2", "Other", None, None, None, False), ("b3", "Title 3", "x", "y", 9, True)], "book_id string, title string, author string, category string, read_update_time bigint, is_deleted boolean")
    got = L.browse_table("books", books, books, "t", 1).collect()
    assert [(r["id"], r["secondary"], r["total"]) for r in got] == [("b1", "An", 2)]
    assert [r["id"] for r in L.browse_table("books", books, books, "", 500, 1).collect()] == ["b2"]
    thoughts = spark.createDataFrame([("t1", "none", "c", "x", 1, False)], "review_id string, book_id string, chapter_name string, content string, create_time bigint, is_deleted boolean")
    assert L.browse_table("thoughts", thoughts, books, "x").first()["secondary"] == ""
    with pytest.raises(ValueError):
        L.browse_table("books; drop", books, books)


def test_page_with_facets(spark):
    rows = [(f"b{i}", f"T{i}", "a", "even" if i % 2 == 0 else None, i, 0, "reading" if i < 4 else "unread", i) for i in range(9)]
    listed = spark.createDataFrame(rows, "book_id string, title string, author string, category string, highlight_count int, thought_count int, reading_status string, read_update_time int")
    got = L.page_with_facets(listed, sort_by="highlights", limit=3, offset=1).collect()
    part = lambda name: [(r["value"], r["n"]) for r in sorted(got, key=lambda r: r["place"]) if r["part"] == name]
    assert [v for v, _ in part("page")] == ["b7", "b6", "b5"] and part("total") == [("", 9)]
    assert set(part("reading_status")) == {("reading", 4), ("unread", 5)} and set(part("category")) == {("even", 5), ("", 4)}
    empty = L.page_with_facets(listed.limit(0)).collect()
    assert [(r["part"], r["n"]) for r in empty] == [("total", 0)]
