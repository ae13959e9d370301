"""Streamed answers folded by request: as a table, and live with keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from .jobs import ROCKS

#: Milliseconds that a session is remembered without an event.
REMEMBER = 24 * 3600 * 1000
ANSWER = "session {key}, request_id string, status string, text string, events bigint"


@dataclass
class Answer:
    """What a session shows: its request, how far that is, and the text so far."""

    request_id: str = ""
    status: str = "idle"
    text: str = ""
    events: int = 0

    def take(self, kind: str, request_id: str, text: str) -> None:
        """One event. Those of an earlier request change nothing, nor does text after the end."""
        self.events += 1
        if kind == "start":
            self.request_id, self.status, self.text = request_id, "streaming", ""
        elif kind == "reset":
            self.request_id, self.status, self.text = "", "idle", ""
        elif not self.request_id or request_id != self.request_id:
            return
        elif kind == "delta" and self.status == "streaming":
            self.text += text
        elif kind == "completed":
            self.status, self.text = "completed", text
        elif kind == "failed":
            self.status = "error"
        elif kind == "cancelled" or (kind == "stop" and self.status == "streaming"):
            self.status = "stopped"


def _plain(f: pd.DataFrame) -> Iterator[tuple[int, str, str, str]]:
    for seq, kind, request_id, text in zip(f["seq"], f["kind"], f["request_id"], f["text"], strict=True):
        yield int(seq), kind or "", request_id or "", text or ""


def _events(events: DataFrame) -> tuple[DataFrame, str]:
    kind = events.schema["session"].dataType.simpleString()
    return events.selectExpr("session", "CAST(seq AS bigint) AS seq", "kind", "request_id", "text"), ANSWER.format(key=kind)


def fold_answers(events: DataFrame) -> DataFrame:
    """``session, request_id, status, text, events`` of the events ``session, seq, kind, request_id, text`` of a table, folded by seq.

    Kinds: start, delta, completed (with the whole text), failed, cancelled,
    stop, reset; others count but change nothing. An event that comes twice
    counts once. A session's events are folded in one task: they are as many as
    one reader's answers have.
    """
    events, schema = _events(events)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        now = Answer()
        for _, kind, request_id, text in _plain(f.drop_duplicates("seq").sort_values("seq")):
            now.take(kind, request_id, text)
        return pd.DataFrame({"session": [f["session"].iloc[0]], "request_id": [now.request_id], "status": [now.status], "text": [now.text], "events": [now.events]})

    return events.groupBy("session").applyInPandas(run, schema)


class LiveAnswers(StatefulProcessor):
    """Folds events in the order of their numbers, from 1, whatever the order they come in: early ones wait."""

    def init(self, handle) -> None:
        self.now = handle.getValueState("now", "request_id string, status string, text string, events bigint, next bigint", ttlDurationMs=REMEMBER)
        self.early = handle.getMapState("early", "seq bigint", "kind string, request_id string, text string", ttlDurationMs=REMEMBER)

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        request_id, status, text, events, next_ = self.now.get() if self.now.exists() else ("", "idle", "", 0, 1)
        now = Answer(request_id, status, text, events)
        came = {seq: rest for f in rows for seq, *rest in _plain(f) if seq >= next_}
        for seq, rest in came.items():
            if seq > next_ and not self.early.containsKey((seq,)):
                self.early.updateValue((seq,), tuple(rest))
        while True:
            if next_ in came:
                event = came[next_]
            elif self.early.containsKey((next_,)):
                event = self.early.getValue((next_,))
            else:
                break
            if self.early.containsKey((next_,)):
                self.early.removeKey((next_,))
            now.take(*event)
            next_ += 1
        self.now.update((now.request_id, now.status, now.text, now.events, next_))
        yield pd.DataFrame({"session": [key[0]], "request_id": [now.request_id], "status": [now.status], "text": [now.text], "events": [now.events]})

    def close(self) -> None:
        pass


def live_answers(events: DataFrame) -> DataFrame:
    """The answers of a stream of events as ``fold_answers`` has them, a row whenever a session has new ones.

    Sessions without an event for REMEMBER milliseconds are forgotten.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    events, schema = _events(events)
    return events.groupBy("session").transformWithStateInPandas(statefulProcessor=LiveAnswers(), outputStructType=schema, outputMode="Update", timeMode="ProcessingTime")
