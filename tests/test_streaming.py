"""Streams driven to their end, restarted, and compared with tables."""

import random

import pytest

from quirewell.streaming import answers, jobs, sync


EVENT = "session string, seq int, kind string, request_id string, text string"
EVENTS = [
    ("a", 1, "delta", "q1", "early"), ("a", 2, "start", "q1", None), ("a", 3, "delta", "q1", "one "), ("a", 4, "delta", "q0", "stale"), ("a", 5, "delta", "q1", "two"), ("a", 6, "stop", "q1", None), ("a", 7, "delta", "q1", "after"),
    ("b", 1, "start", "r1", None), ("b", 2, "delta", "r1", "x"), ("b", 3, "start", "r2", None), ("b", 4, "completed", "r1", "old"), ("b", 5, "delta", "r2", "y"), ("b", 6, "completed", "r2", "whole"), ("b", 7, "stop", "r2", None),
    ("c", 1, "start", "s1", None), ("c", 2, "delta", "s1", "z"), ("c", 3, "failed", "s1", None), ("d", 1, "start", "t", None), ("d", 2, "reset", None, None), ("e", 1, None, None, None),
]
WANT = {("a", "q1", "stopped", "one two", 7), ("b", "r2", "completed", "whole", 7), ("c", "s1", "error", "z", 3), ("d", "", "idle", "", 2), ("e", "", "idle", "", 1)}


def test_fold(spark):
    rows = EVENTS + EVENTS[2:4]
    random.Random(1).shuffle(rows)
    assert set(map(tuple, answers.fold_answers(spark.createDataFrame(rows, EVENT)).collect())) == WANT
    assert answers.fold_answers(spark.createDataFrame([], EVENT)).count() == 0


def test_live_fold(spark, tmp_path):
    """Shuffled micro-batches, events that come twice and restarts: the last rows are those of the table."""
    rows = EVENTS + EVENTS[1:6]
    random.Random(2).shuffle(rows)
    last = {}

    def see(batch, number):
        last.update({r["session"]: tuple(r) for r in batch.collect()})

    for i in range(4):
        spark.createDataFrame(rows[i::4], EVENT).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in/*")
        query = answers.live_answers(stream).writeStream.outputMode("update").foreachBatch(see).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(once=True).start()
        assert query.awaitTermination(120)
    assert set(last.values()) == WANT


def test_jobs_over_restarts(spark, tmp_path):
    """A job that was paused in one run goes on in the next; refused requests are rows."""
    batches = [[("a", 1, "downloading"), ("a", 2, "paused"), ("b", 1, "completed"), ("b", 2, None)], [("a", 3, "resume"), ("a", 4, "publishing"), ("b", 3, "cancelled"), ("b", 4, "parsing"), ("c", 1, "resume")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "job_id string, at int, asked string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        moves = jobs.job_moves(spark.readStream.schema("job_id string, at int, asked string").parquet(f"{tmp_path}/in/*"))
        got = jobs.to_end(moves, str(tmp_path))
    got = {(r["job_id"], r["at"]): (r["was"], r["now"], r["accepted"]) for r in got.collect()}
    assert got == {
        ("a", 1): ("pending", "downloading", True), ("a", 2): ("downloading", "paused", True), ("a", 3): ("paused", "downloading", True), ("a", 4): ("downloading", "downloading", False),
        ("b", 1): ("pending", "pending", False), ("b", 2): ("pending", "pending", False), ("b", 3): ("pending", "cancelled", True), ("b", 4): ("cancelled", "cancelled", False), ("c", 1): ("pending", "pending", False),
    }


def test_transitions():
    assert jobs.advance("parsing", "resolving_redirects", None) == "resolving_redirects" and jobs.advance("pending", "paused", None) == "paused"
    assert jobs.advance("paused", "resume", "validating") == "validating" and jobs.advance("paused", "resume", None) == "parsing"
    assert jobs.advance("downloading", "parsing", None) is None and jobs.advance("completed", "parsing", None) is None and jobs.advance("nonsense", "parsing", None) is None


def test_sse():
    assert list(sync.sse_lines([b"data: a\nda", b"ta: b\r\n\n", b"data: [DONE]\ndata: c\n"])) == ["a", "b"]
    with pytest.raises(ValueError):
        list(sync.sse_lines([b"x" * 20], most=10))
