"""Conversations that fill in a form, turn by turn, as a stateful stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

IDLE_MS = 1_800_000
SKIPPED = "__SKIPPED__"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def next_turn(mode: str, answers: dict[str, str], asked: str | None, kind: str, value: str | None, fields: list[str], valid: Callable[[str, str], bool]) -> tuple[str, dict[str, str], str | None, str]:
    """Mode, answers, the field asked for, and what came of a turn.

    Kinds: "open" starts a form (the first field without an answer is asked for), "answer" and "skip" fill the field asked for, "cancel" leaves the
    form and keeps the answers; any other is a question beside the form. An answer that is not valid is not kept, and its field is asked for again. A form without a missing
    field is complete; the next one starts without answers."""
    if kind == "open" and mode != "form":
        mode = "form"
    elif mode != "form":
        return mode, answers, None, "idle"
    elif kind == "cancel":
        return "rag", answers, None, "cancelled"
    elif kind in ("answer", "skip"):
        if kind == "answer" and (value is None or not valid(asked, value)):
            return mode, answers, asked, "invalid"
        answers = answers | {asked: SKIPPED if kind == "skip" else value}
    elif kind != "open":
        return mode, answers, asked, "digression"
    missing = next((f for f in fields if f not in answers), None)
    if missing is None:
        return "rag", answers, None, "complete"
    return mode, answers, missing, "asked"


class Conversations(StatefulProcessor):
    """Typed state for each conversation: its mode, the field asked for, the time of its last turn, and the answers by field. A timer ends what was idle for too long."""

    def __init__(self, key: str, fields: list[str], valid: Callable[[str, str], bool], idle_ms: int = IDLE_MS):
        self.key, self.fields, self.valid, self.idle_ms = key, fields, valid, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "mode string, asked string, last long")
        self.answers = handle.getMapState("answers", "field string", "value string")

    def _forget(self) -> None:
        self.now.clear()
        self.answers.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        """The turns of a micro-batch, in the order of time and event_id."""
        mode, asked, last = ("rag", None, None) if not self.now.exists() else self.now.get()
        answers = {k[0]: v[0] for k, v in self.answers.iterator()} if self.now.exists() else {}
        out = []
        for row in sorted(rows, key=lambda r: (r["at"], r["event_id"])):
            if last is not None and row["at"] > last + self.idle_ms:
                mode, answers, asked = "rag", {}, None
            last = row["at"] if last is None else max(last, row["at"])
            mode, answers, asked, status = next_turn(mode, answers, asked, row["kind"], row["value"], self.fields, self.valid)
            given = sum(v != SKIPPED for v in answers.values())
            out.append(Row(**{self.key: key[0], "event_id": row["event_id"], "mode": mode, "asked": asked, "collected": given, "status": status}))
            if status == "complete":
                answers = {}
        self._forget()
        self.now.update((mode, asked, last))
        for field, value in answers.items():
            self.answers.updateValue((field,), (value,))
        self.handle.registerTimer(max(last + self.idle_ms, timerValues.getCurrentWatermarkInMs()) + 1)
        yield from out

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self._forget()
        return iter([])

    def close(self) -> None:
        pass


def conversation_turns(stream: DataFrame, key: str, fields: list[str], valid: Callable[[str, str], bool] = lambda field, value: value.strip() != "", idle_ms: int = IDLE_MS, watermark: str = "1 hour") -> DataFrame:
    """key, event_id, mode, asked, collected, status after each turn of a stream (key, event_id, ts, kind, value); see next_turn().

    A conversation without a turn for longer than idle_ms starts anew. State is kept in RocksDB (this sets the session's provider) and goes by an event-time timer;
    rows later than the watermark allows are dropped. Of the rows of one micro-batch only those of one conversation are held at once."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.withWatermark("ts", watermark).select(key, "event_id", "ts", F.unix_millis("ts").alias("at"), "kind", "value")
    return rows.groupBy(key).transformWithState(Conversations(key, fields, valid, idle_ms), f"{key} {kind}, event_id long, mode string, asked string, collected int, status string", "Append", "EventTime")
