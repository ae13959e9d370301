"""Incremental sync as Structured Streaming: latest-wins upserts, windows, and the lines of server-sent streams."""

from __future__ import annotations

import math
import time
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.library import latest
from ..sources.versions import VersionedTable

def upsert_stream(events: DataFrame, table: VersionedTable, checkpoint: str, order: str, name: str = "sync") -> StreamingQuery:
    """Each micro-batch, reduced to its latest row per key by ``order``, is a version of ``table``.

    Batches are named, so one that is run again after a restart changes nothing.
    An optional boolean column ``is_deleted`` removes rows.
    """

    def put(batch: DataFrame, number: int) -> None:
        rows = latest(batch, table.keys, F.desc(order))
        gone = rows.where("is_deleted") if "is_deleted" in rows.columns else None
        rows = rows.where("NOT coalesce(is_deleted, false)") if gone is not None else rows
        table.apply(rows.select(*table.schema.names), f"{name}-{number}", gone)

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 day") -> DataFrame:
    """Events per window and type, each event once."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select("w.start", "event_type", "n")


def sse_lines(chunks: Iterator[bytes], most: int = 16 << 20) -> Iterator[str]:
    """The data fields of a server-sent stream whose lines may be cut anywhere; ends at ``[DONE]``."""
    rest, size = b"", 0
    for chunk in chunks:
        size += len(chunk)
        if size > most:
            raise ValueError("the answer is too long")
        *lines, rest = (rest + chunk).split(b"\n")
        for line in lines:
            line = line.rstrip(b"\r")
            if line.startswith(b"data:"):
                data = line[5:].strip().decode("utf-8", "replace")
                if data == "[DONE]":
                    return
                yield data


class ProgressRows(StreamingQueryListener):
    """Progress of streams as rows: percent rises only, at most one row for each query in ``every`` seconds, 100 when it ends.

    Between its start (10) and 90 a query's percent follows the rows it has read
    of ``total``. The last ``most`` rows are remembered.
    """

    def __init__(self, total: int, every: float = 1.0, most: int = 10_000, clock=time.monotonic) -> None:
        self.total, self.every, self.clock = max(1, total), every, clock
        self.rows: deque[tuple[str, int, int, float]] = deque(maxlen=most)
        self.read: dict[str, int] = {}
        self.last: dict[str, tuple[float, int]] = {}

    def _tell(self, query: str, percent: int, always: bool = False) -> None:
        now = self.clock()
        when, before = self.last.get(query, (-math.inf, 0))
        if percent > before and (always or now - when >= self.every):
            self.last[query] = now, percent
            self.rows.append((query, len(self.rows), percent, now))

    def onQueryStarted(self, event) -> None:
        self.read[str(event.runId)] = 0
        self._tell(str(event.runId), 10, True)

    def onQueryProgress(self, event) -> None:
        query = str(event.progress.runId)
        self.read[query] = self.read.get(query, 0) + int(event.progress.numInputRows)
        self._tell(query, 10 + int(80 * min(1.0, self.read[query] / self.total)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if not event.exception:
            self._tell(str(event.runId), 100, True)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), "query string, n int, percent int, at double")
