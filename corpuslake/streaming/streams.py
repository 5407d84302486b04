"""Structured Streaming: ingestion, answer reuse, conversation state, reports, sessions, answer joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1, glob: str | None = None) -> DataFrame:
    """A stream of Parquet files; ts becomes a timestamp, as event time needs."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


class LateRows(StreamingQueryListener):
    """Counts the rows that queries drop because they come later than their watermark allows, by the name of the query (its id if it has none).
    To be added by spark.streams.addListener(); a stateful operator's count is that of its input, so pre-aggregated rows count once a group."""

    def __init__(self) -> None:
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        name = event.progress.name or str(event.progress.id)
        self.dropped[name] = self.dropped.get(name, 0) + sum(x.numRowsDroppedByWatermark for x in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def _run(writer, checkpoint: str, mode: str, name: str | None) -> None:
    writer = writer.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    (writer.queryName(name) if name else writer).start().awaitTermination()


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", name: str | None = None) -> None:
    """Write all that is there to Parquet, exactly once, and stop."""
    _run(stream.writeStream.format("parquet").option("path", path), checkpoint, mode, name)


def run_batches(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "update", name: str | None = None) -> None:
    """Give each micro-batch to a function, and stop when all that is there is done. A batch may come again: the function must be idempotent."""
    _run(stream.writeStream.foreachBatch(each), checkpoint, mode, name)


def _first(ttl_ms: int) -> Callable:
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """The rows that find no stored answer of their key. The time of the one stored is the state, and goes when it can't be reused."""
        if state.hasTimedOut:
            state.remove()
            return
        parts = [(f["ts"].to_numpy("datetime64[us]").astype(np.int64), f["event_id"].to_numpy()) for f in frames]
        times, events = (np.concatenate(x) for x in zip(*parts, strict=True))
        none = np.iinfo(np.int64).min  # rows without a time come last
        order = np.lexsort((events, times, times == none))
        stored = state.get[0] if state.exists else None
        first = []
        for event, at in zip(events[order].tolist(), times[order].tolist(), strict=True):
            if stored is None or at > stored + ttl_ms * 1000:
                stored = at
                first.append(event)
        state.update((stored,))
        state.setTimeoutTimestamp(max(stored // 1000 + ttl_ms, state.getCurrentWatermarkMs()) + 1)
        if first:
            yield pd.DataFrame({"event_id": first, "user_id": [key[0]] * len(first), "event_type": [key[1]] * len(first)})

    return run


def first_answers(stream: DataFrame, ttl_hours: float = 6) -> DataFrame:
    """event_id, user_id, event_type of the rows that are answered anew: no answer of their key was stored at most ttl_hours before. A reused answer is
    not stored again."""
    rows = stream.withWatermark("ts", f"{int(ttl_hours * 3600)} seconds").select("user_id", "event_type", "event_id", "ts")
    return rows.groupBy("user_id", "event_type").applyInPandasWithState(_first(int(ttl_hours * 3_600_000)), "event_id long, user_id long, event_type string", "stored long", "append", GroupStateTimeout.EventTimeTimeout)


def daily_counts(stream: DataFrame, by: str, watermark: str = "1 day") -> DataFrame:
    """Counts by day; later rows than the watermark allows are dropped."""
    return stream.withWatermark("ts", watermark).groupBy(F.window("ts", "1 day"), by).agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), by, "n")


def sliding_counts(stream: DataFrame, by: str, length: str = "30 days", slide: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """Counts over windows of `length` that begin every `slide`: first and last day, by, n; later rows than the watermark allows are dropped."""
    counts = stream.withWatermark("ts", watermark).groupBy(F.window("ts", length, slide), by).agg(F.count("*").alias("n"))
    return counts.select(F.to_date("window.start").alias("day"), F.to_date(F.col("window.end") - F.expr("interval 1 day")).alias("last_day"), by, "n")


def sessions(stream: DataFrame, by: str, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """Sessions that end after a gap without rows."""
    return stream.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap), by).agg(F.count("*").alias("n")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def answers_within(questions: DataFrame, answers: DataFrame, by: str, within: str = "5 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Questions with the answers of the same group at most `within` later: both sides keep state only as long as the watermark needs."""
    q = questions.withWatermark("ts", watermark).select(F.col(by).alias("_q"), F.col("ts").alias("asked"), F.col("event_id").alias("question_id"))
    a = answers.withWatermark("ts", watermark).select(F.col(by), F.col("ts").alias("answered"), F.col("event_id").alias("answer_id"))
    return q.join(a, F.expr(f"{by} = _q and answered >= asked and answered <= asked + interval {within}")).select(by, "question_id", "answer_id")
