"""What the findings of round 4 named."""

import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quirewell.operators import graph as G
from quirewell.plans import streams
from quirewell.sources import cursor
from quirewell.sources.cursor import FIRST, CursorError, Folder, LandedPages


def test_names_of_many_books(spark, monkeypatch):
    """names of more than 80 books made no edges."""
    monkeypatch.setattr(G, "KEY_BLOCK", 30)
    monkeypatch.setattr(G, "KEY_PARTS", 3, raising=False)
    named = {f"b{i:03}": ([" Hot", f"w{i % 50}"], ["S", f"s{i % 3}", "s ", None][: i % 5], ["T"] if i % 2 else None) for i in range(200)}
    meta = spark.createDataFrame([(b, *x) for b, x in named.items()], "book_id string, authors array<string>, subjects array<string>, translators array<string>")
    clean = {b: [{n.strip().lower() for n in names or [] if n} for names in x] for b, x in named.items()}
    want = {}
    for a in clean:
        for b in clean:
            for kind, x, y in zip(("author", "subject", "translator"), clean[a], clean[b], strict=True):
                if a < b and x & y:
                    want[a, b, kind] = ({"author": 0.94, "translator": 0.9}.get(kind) or round(0.48 + 0.08 * len(x & y), 6), sorted(x & y))
    got = G.metadata_edges(meta).collect()
    assert {(r["a"], r["b"], r["kind"]): (r["score"], r["labels"]) for r in got} == want and len(got) == len(want) > 19900


def shuffled(spark) -> int:
    """Rows that all stages so far have written for others."""
    gateway = spark.sparkContext._gateway
    none = lambda: gateway.jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none(), False, False, gateway.new_array(gateway.jvm.double, 0), none())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_what_is_shuffled_follows_the_rows(spark, monkeypatch):
    """a row went to as many units as its key had blocks, so disk grew with the pairs."""
    monkeypatch.setattr(G, "KEY_BLOCK", 5)
    monkeypatch.setattr(G, "KEY_PARTS", 4, raising=False)
    rows = [(i, "hot" if i % 10 else None if i % 20 else f"rare {i // 40}", ("x", "y", "z", None)[i % 4]) for i in range(600)] + [(0, "hot", "x"), (None, "hot", "y"), (1, "hot", "z"), (1, "hot", "z")]
    want = sorted((a, b) for a, k, v in rows for b, m, w in rows if a is not None and b is not None and a < b and k is not None and k == m and v and w and v != w)
    t = spark.createDataFrame(rows, "n long, k string, v string")
    before = shuffled(spark)
    got = G.conflicts(t, "k", "n", "v").collect()
    assert shuffled(spark) - before < 2 * len(rows)
    assert sorted(map(tuple, got)) == want
    monkeypatch.setattr(G, "KEY_MOST", 20, raising=False)  # more blocks than KEY_PARTS, as none holds more
    assert sorted(map(tuple, G.conflicts(t, "k", "n", "v").collect())) == want
    big = spark.range(3000).select(F.col("id").alias("n"), F.lit("k").alias("k"), (F.col("id") % 2).alias("v"))
    assert G.conflicts(big, "k", "n", "v").count() == 1500 * 1500


@pytest.mark.parametrize("by_items", [True, False])
def test_pages_land_packed(spark, by_items):
    """each page was a file in a folder of its own, and a chain was put in order by one task."""
    size = {"a": 1234, "b": 300, "c": 1, "d d": 100}
    rows = spark.createDataFrame([(c, i * 7 % 5000 if c == "a" else i, f"{c}{i}") for c, n in size.items() for i in range(n)], "chain string, sort long, id string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = streams._land(spark, rows.repartition(3), by_items)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(f.endswith((".parquet", ".txt")) for _, _, files in os.walk(path.removeprefix("file://")) for f in files) <= len(size)
    spark.dataSource.register(LandedPages)
    got = spark.read.format("landed_pages").option("path", path).option("cursor", "items" if by_items else "next").load().collect()
    want = []
    for c, n in size.items():
        order = sorted(((r["sort"], r["id"]) for r in rows.where(F.col("chain") == c).collect()), reverse=True)
        assert len(order) == n
        want += [(c, FIRST if i < 100 else str(order[i // 100 * 100 - 1][0]) if by_items else f"key{i // 100 - 1}", i % 100, id_) for i, (_, id_) in enumerate(order)]
    assert sorted((r["chain"], r["cursor"], r["position"], json.loads(r["item"])["id"]) for r in got) == sorted(want)


def pack(path, name, pages, groups=2):
    """A packed file of ``cursor, has_more, next, items``; the items' sorts are given."""
    at = f"{path}/chain=c/pages=packed"
    os.makedirs(at, exist_ok=True)
    rows = [{"cursor": c, "has_more": more, "next": after, "last": str(items[-1]) if items else None, "items": [json.dumps({"sort": x}) for x in items] if items is not None else None} for c, more, after, items in pages]
    schema = pa.schema({"cursor": pa.string(), "has_more": pa.int32(), "next": pa.string(), "last": pa.string(), "items": pa.list_(pa.string())})
    pq.write_table(pa.Table.from_pylist(rows, schema), f"{at}/{name}.parquet", row_group_size=groups)
    return at


def found(folder, by_chain):
    return [(r["cursor"], r["position"], json.loads(r["item"])["sort"]) for pages in folder.dealt({c: w[0] for c, w in by_chain.items()}) for b in folder.rows(pages) for r in b.to_pylist()]


def test_packed_pages_are_followed(tmp_path, monkeypatch):
    """in any order, beside pages in folders of their own, and each once; files that land later are read when they have."""
    monkeypatch.setattr(cursor, "PACKED", 3)
    monkeypatch.setattr(cursor, "TOGETHER", 2)
    folder = Folder({"path": str(tmp_path)})
    pack(tmp_path, "x", [("k2", 1, "k3", [6]), ("lost", 0, None, [99]), (FIRST, 1, "k1", [9, 8]), ("k1", 1, "k2", None), ("k3", 1, "k4", [5, 4, 3]), (FIRST, 0, None, [77])])
    walked = folder.walk_all({})
    assert walked == {"c": ([FIRST, "k1", "k2", "k3"], "k4")}
    assert sorted(found(folder, walked)) == [(FIRST, 0, 9), (FIRST, 1, 8), ("k2", 0, 6), ("k3", 0, 5), ("k3", 1, 4), ("k3", 2, 3)]
    single = f"{tmp_path}/chain=c/cursor=k4"
    os.makedirs(single)
    with open(f"{single}/page.json", "w") as f:
        json.dump({"items": [{"sort": 2}], "has_more": 1, "next": "k5"}, f)
    assert folder.walk_all({"c": "k4"}) == {"c": (["k4"], "k5")}
    pack(tmp_path, "y", [("k5", 0, "k6", [1])])
    walked = folder.walk_all({"c": "k4"})
    assert walked == {"c": (["k4", "k5"], None)} and found(folder, walked) == [("k4", 0, 2), ("k5", 0, 1)]


def test_errors_of_packed_pages(tmp_path):
    for name, pages, message in (("cursor", [(FIRST, 1, "k", [])], "no cursor"), ("stands", [(FIRST, 1, None, [5]), ("5", 1, None, [5])], "stands"), ("back", [(FIRST, 1, None, [5]), ("5", 1, None, [4]), ("4", 1, None, [5])], "comes back")):
        pack(tmp_path / name, "x", pages)
        with pytest.raises(CursorError, match=message):
            Folder({"path": str(tmp_path / name), "cursor": "items"}).walk("c", FIRST)
    at = pack(tmp_path / "ends", "x", [(FIRST, 0, None, [5, 4])])
    t = pq.read_table(f"{at}/x.parquet", partitioning=None)
    pq.write_table(t.set_column(3, "last", pa.array(["3"])), f"{at}/x.parquet")
    folder = Folder({"path": str(tmp_path / "ends"), "cursor": "items"})
    with pytest.raises(CursorError, match="ends at 4, not at 3"):
        found(folder, folder.walk_all({}))
