"""Cursor pages, versions and progress: order, restarts, errors, lost writes."""

import json
import os

import pytest
from pyspark.sql import functions as F

from quirewell.sources.cursor import FIRST, CursorError, Folder, LandedPages
from quirewell.sources.versions import Conflict, VersionedTable
from quirewell.streaming import sync


def land(path, chain, cursor, items, has_more=0, **more):
    at = f"{path}/chain={chain}/cursor={cursor}"
    os.makedirs(at, exist_ok=True)
    with open(f"{at}/page.json", "w") as f:
        json.dump({"items": items, "has_more": has_more, **more}, f)


def shelf(path, chain="shelf", pages=3):
    """Pages of two books each, newest first; the cursor is the last one's place."""
    for p in range(pages):
        top = 100 - 2 * p
        land(path, chain, FIRST if p == 0 else top + 1, [{"id": f"b{top}", "sort": top}, {"id": f"b{top - 1}", "sort": top - 1}], int(p < pages - 1))


def ids(rows):
    return sorted((r["chain"], r["position"], json.loads(r["item"])["id"]) for r in rows)


def test_pages_of_a_shelf(spark, tmp_path):
    spark.dataSource.register(LandedPages)
    shelf(tmp_path), shelf(tmp_path, "my%3A é", 1)
    rows = spark.read.format("landed_pages").option("path", str(tmp_path)).option("cursor", "items").load()
    assert ids(rows.collect()) == [("my: é", 0, "b100"), ("my: é", 1, "b99"), *sorted(("shelf", i % 2, f"b{100 - i}") for i in range(6))]
    assert spark.read.format("landed_pages").option("path", f"{tmp_path}/none").load().count() == 0


def test_pages_without_a_cursor(spark, tmp_path):
    spark.dataSource.register(LandedPages)
    land(tmp_path, "shelf", FIRST, [], 1)
    with pytest.raises(CursorError):
        Folder({"path": str(tmp_path), "cursor": "items"}).walk("shelf", FIRST)
    with pytest.raises(Exception, match="has more, but no cursor"):
        spark.read.format("landed_pages").option("path", str(tmp_path)).option("cursor", "items").load().collect()


def test_standing_cursor(tmp_path):
    folder = Folder({"path": str(tmp_path)})
    land(tmp_path, "book", FIRST, [{"id": 1}], 1, next=5)
    land(tmp_path, "book", 5, [{"id": 2}], 1, next=5)
    with pytest.raises(CursorError, match="stands"):
        folder.walk("book", FIRST)
    land(tmp_path, "ring", FIRST, [{"id": 1}], 1, next=5)
    land(tmp_path, "ring", 5, [{"id": 2}], 1, next=6)
    land(tmp_path, "ring", 6, [{"id": 2}], 1, next=5)
    with pytest.raises(CursorError, match="comes back"):
        folder.walk("ring", FIRST)


def run(spark, tmp_path, out):
    stream = spark.readStream.format("landed_pages").option("path", f"{tmp_path}/in").load()
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    return ids(spark.read.parquet(out).collect())


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    """Pages that land later, and chains that begin later, are read once each after a restart."""
    spark.dataSource.register(LandedPages)
    at, out = f"{tmp_path}/in", f"{tmp_path}/out"
    land(at, "x", FIRST, [{"id": "x1"}], 1, next=7)
    land(at, "y", FIRST, [{"id": "y1"}])
    assert run(spark, tmp_path, out) == [("x", 0, "x1"), ("y", 0, "y1")]
    land(at, "x", 7, [{"id": "x2"}], 1, next=9)
    land(at, "z", FIRST, [{"id": "z1"}, {"id": "z2"}])
    assert run(spark, tmp_path, out) == [("x", 0, "x1"), ("x", 0, "x2"), ("y", 0, "y1"), ("z", 0, "z1"), ("z", 1, "z2")]
    land(at, "x", 9, [{"id": "x3"}])
    assert len(run(spark, tmp_path, out)) == 6 and len(run(spark, tmp_path, out)) == 6


SCHEMA = "k int, v string, n int"


def table(spark, tmp_path):
    return VersionedTable(spark, f"file://{tmp_path}/t", ["k"], SCHEMA)


def rows(t, version=None):
    return sorted(map(tuple, t.read(version).collect()))


def test_versions(spark, tmp_path):
    t = table(spark, tmp_path)
    make = lambda *r: spark.createDataFrame(r, SCHEMA)
    assert rows(t) == []
    t.apply(make((1, "a", 1), (2, "b", 1)), "one")
    t.apply(make((1, None, 2), (3, "c", 2), (3, "d", 2)), "two", make((2, "", 0), (9, "", 0)))
    assert rows(t) == [(1, None, 2), (3, "d", 2)] and rows(t, 1) == [(1, "a", 1), (2, "b", 1)]
    assert t.apply(make((1, "again", 9)), "two") == 2 and t.versions() == [1, 2]
    t.compact()
    assert rows(t) == [(1, None, 2), (3, "d", 2)] and len(t.manifest()["parts"]) == 1
    t.apply(make((2, "back", 3)), "three")
    assert rows(t) == [(1, None, 2), (2, "back", 3), (3, "d", 2)]
    assert t.vacuum(1) == 2 and t.versions() == [4] and rows(t) == [(1, None, 2), (2, "back", 3), (3, "d", 2)]
    assert t.apply(make((5, "x", 1)), "one") == 4  # still known


def test_lost_between_write_and_commit(spark, tmp_path, monkeypatch):
    """Rows without a manifest don't count; the batch is applied anew, and the folder goes with the next vacuum."""
    t = table(spark, tmp_path)
    make = lambda *r: spark.createDataFrame(r, SCHEMA)
    t.apply(make((1, "a", 1)), "one")
    commit = VersionedTable._commit
    monkeypatch.setattr(VersionedTable, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        t.apply(make((1, "b", 2)), "two")
    monkeypatch.setattr(VersionedTable, "_commit", commit)
    assert rows(t) == [(1, "a", 1)]
    t.apply(make((1, "b", 2)), "two")
    assert rows(t) == [(1, "b", 2)] and t.vacuum(5) == 1


def test_two_writers(spark, tmp_path):
    t = table(spark, tmp_path)
    t.apply(spark.createDataFrame([(1, "a", 1)], SCHEMA))
    with pytest.raises(Conflict):
        t._commit({"version": 1, "parts": [], "batches": []})
    assert rows(t) == [(1, "a", 1)]


def test_upsert_stream(spark, tmp_path):
    schema, t = SCHEMA + ", is_deleted boolean", table(spark, tmp_path)
    for i, part in enumerate([[(1, "a", 1, False), (2, "b", 1, False), (1, "old", 0, False)], [(1, "c", 2, None), (2, "b", 3, True), (3, "d", 2, False)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        sync.upsert_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"), t, f"{tmp_path}/checkpoint", "n").awaitTermination(60)
    assert rows(t) == [(1, "c", 2), (3, "d", 2)] and t.versions() == [1, 2]


def test_progress_rows(spark, tmp_path):
    class Event:
        def __init__(self, run, rows=0, exception=None):
            self.runId, self.exception = run, exception
            self.progress = type("P", (), {"runId": run, "numInputRows": rows})

    now = [0.0]
    p = sync.ProgressRows(100, clock=lambda: now[0])
    p.onQueryStarted(Event("a"))
    for at, n in ((0.5, 10), (1.5, 20), (1.9, 20), (3.0, 0), (4.0, 0), (5.0, 500)):
        now[0] = at
        p.onQueryProgress(Event("a", n))
    p.onQueryTerminated(Event("a"))
    p.onQueryStarted(Event("b")), p.onQueryTerminated(Event("b", exception="lost"))
    assert [(q, x) for q, _, x, _ in p.rows] == [("a", 10), ("a", 34), ("a", 50), ("a", 90), ("a", 100), ("b", 10)]
    live = sync.ProgressRows(60, every=0.0)
    spark.streams.addListener(live)
    try:
        query = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 20).load().writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="200 milliseconds").start()
        while query.lastProgress is None or query.lastProgress.batchId < 4:
            query.awaitTermination(1)
        query.stop()
    finally:
        spark.streams.removeListener(live)
    seen = [r["percent"] for r in live.frame(spark).orderBy("n").collect()]
    assert seen[0] == 10 and seen == sorted(set(seen)) and seen[-1] in (90, 100)


def test_daily_counts(spark, tmp_path):
    """Events that come twice count once."""
    schema = "event_id int, ts timestamp, event_type string"
    part = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (3, "b")], "event_id int, event_type string").withColumn("ts", F.lit("2024-01-05 10:00:00").cast("timestamp")).select("event_id", "ts", "event_type")
    part.coalesce(1).write.parquet(f"{tmp_path}/in/0")
    got = {}
    counts = sync.daily_counts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"))
    counts.writeStream.outputMode("update").foreachBatch(lambda b, n: got.update({r["event_type"]: r["n"] for r in b.collect()})).option("checkpointLocation", f"{tmp_path}/c").trigger(once=True).start().awaitTermination(60)
    assert got == {"a": 2, "b": 1}
