"""States of import jobs, one keyed state for each job: transitions as they are asked for, refused ones as rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

#: States of an import job and the states that each may go to.
STAGES = ["pending", "downloading", "verifying", "parsing", "resolving_redirects", "validating", "ready_to_publish", "publishing"]
TERMINAL = {"completed", "cancelled", "failed"}
_ALWAYS = {"failed", "cancelled", "paused"}
TRANSITIONS = {
    "pending": {"downloading", "verifying", "parsing"} | _ALWAYS,
    "downloading": {"verifying"} | _ALWAYS,
    "verifying": {"parsing"} | _ALWAYS,
    "parsing": {"resolving_redirects"} | _ALWAYS,
    "resolving_redirects": {"validating"} | _ALWAYS,
    "validating": {"ready_to_publish"} | _ALWAYS,
    "ready_to_publish": {"publishing", "completed"} | _ALWAYS,
    "publishing": {"completed"} | _ALWAYS,
    "paused": {*STAGES, "failed", "cancelled"},
    **{state: set() for state in TERMINAL},
}
#: Fixed value: where a paused job goes on whose stage isn't known.
RESUME = "parsing"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MOVES = "job_id {key}, at bigint, was string, asked string, now string, accepted boolean"


def advance(state: str, asked: str, paused_from: str | None) -> str | None:
    """The state after a request, ``resume`` being one for the stage that the pause was in; None if it may not be."""
    if asked == "resume":
        asked = (paused_from or RESUME) if state == "paused" else ""
    return asked if asked in TRANSITIONS.get(state, ()) else None


class JobStates(StatefulProcessor):
    """Keeps a job's state and the stage that it was paused in; gives a row for each request."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("state", "state string, paused_from string")

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values("at", kind="stable")
        state, paused_from = self.state.get() if self.state.exists() else (STAGES[0], None)
        out = []
        for at, want in zip(asked["at"], asked["asked"], strict=True):
            now = advance(state, want, paused_from)
            out.append((key[0], at, state, want, now or state, now is not None))
            if now == "paused":
                paused_from = state
            state = now or state
        self.state.update((state, paused_from))
        yield pd.DataFrame(out, columns=["job_id", "at", "was", "asked", "now", "accepted"])

    def close(self) -> None:
        pass


def job_moves(requests: DataFrame) -> DataFrame:
    """``job_id, at, was, asked, now, accepted`` for every request ``job_id, at, asked``, in the order of ``at`` within a batch.

    ``requests`` is a stream; jobs begin as pending, and their states outlive
    batches and restarts (a RocksDB store). A state that may not follow is
    refused: the job stays as it is, and the row says so. Null requests are refused.
    """
    spark = requests.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # keyed state of this kind needs it
    kind = requests.schema["job_id"].dataType.simpleString()
    rows = requests.selectExpr("job_id", "CAST(at AS bigint) AS at", "coalesce(asked, '') AS asked")
    return rows.groupBy("job_id").transformWithStateInPandas(statefulProcessor=JobStates(), outputStructType=MOVES.format(key=kind), outputMode="Append", timeMode="None")


def to_end(stream: DataFrame, folder: str) -> DataFrame:
    """All rows of a stream whose source is finite now: run until it is used up, written below ``folder`` and read back."""
    out = f"{folder}/rows"
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
