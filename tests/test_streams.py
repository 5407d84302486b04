"""Streams against plain versions, with restarts, late rows and documents that change."""

import collections
import datetime
import random

import pytest
from pyspark.sql import functions as F

from corpuslake.streaming import streams
from corpuslake.streaming.conversation import IDLE_MS, SKIPPED, conversation_turns
from corpuslake.streaming.upserts import ChunkTable, ingest, retry

START = datetime.datetime(2024, 1, 1)
TURNS = "user_id long, event_id long, ts timestamp, kind string, value string"
FIELDS = ["a", "b"]


def plain_turns(log):
    """Each conversation's turns in order, by the rules of next_turn()."""
    out, users = {}, collections.defaultdict(list)
    for row in log:
        users[row[0]].append(row)
    for user, rows in users.items():
        form, got, last = False, {}, None
        for _, event, ts, kind, value in sorted(rows, key=lambda r: (r[2], r[1])):
            if last is not None and (ts - last).total_seconds() * 1000 > IDLE_MS:
                form, got = False, {}
            last = ts
            status, shown = "idle", None
            if kind == "open" and not form:
                form, status = True, "asked"
            elif form and kind == "cancel":
                form, status = False, "cancelled"
            elif form and kind == "skip":
                got[FIELDS[len(got)]] = SKIPPED
                status = "asked"
            elif form and kind == "answer":
                status = "asked" if value and value.strip() else "invalid"
                if status == "asked":
                    got[FIELDS[len(got)]] = value
            elif form:
                status = "asked" if kind == "open" else "digression"
            if status == "asked" and len(got) == len(FIELDS):
                status, form = "complete", False
            shown = sum(v != SKIPPED for v in got.values())
            out[user, event] = ("form" if form else "rag", FIELDS[len(got)] if form else None, shown, status)
            if status == "complete":
                got = {}
    return out


def test_conversations_after_a_restart(spark, tmp_path):
    pick = random.Random(8)
    log, now = [], START
    for event in range(240):
        now += datetime.timedelta(minutes=pick.choice([0, 1, 2, 3, 12]))
        log.append((pick.randint(1, 4), event, now, pick.choice(["open", "answer", "answer", "skip", "cancel", "ask"]), pick.choice(["x", " ", None, "y"])))
    for i in range(3):
        spark.createDataFrame(log[80 * i : 80 * (i + 1)], TURNS).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))

    def run(parts):
        for i in parts:
            for f in (tmp_path / f"part{i}").glob("*.parquet"):
                (tmp_path / "in").mkdir(exist_ok=True)
                f.rename(tmp_path / "in" / f"{i}.parquet")
        source = streams.read_events(spark, str(tmp_path / "in"), TURNS)
        streams.run_once(conversation_turns(source, "user_id", FIELDS), str(tmp_path / "out"), str(tmp_path / "checkpoint"))

    run([0, 1])
    run([2])  # another query, from the checkpoint
    got = {(r.user_id, r.event_id): (r.mode, r.asked, r.collected, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = plain_turns(log)
    assert got == want and {w[3] for w in want.values()} == {"idle", "asked", "cancelled", "invalid", "digression", "complete"}


def test_late_rows_are_counted(spark, tmp_path):
    days = lambda xs: spark.createDataFrame([(START + datetime.timedelta(days=d), k) for d, k in xs], "ts timestamp, kind string").coalesce(1)
    (tmp_path / "in").mkdir()
    for i, rows in enumerate([[(0, "a"), (10, "a")], [(11, "b")], [(1, "late"), (12, "a")]]):
        days(rows).write.parquet(str(tmp_path / f"p{i}"))
        next((tmp_path / f"p{i}").glob("*.parquet")).rename(tmp_path / "in" / f"{i}.parquet")
    late = streams.LateRows()
    spark.streams.addListener(late)
    try:
        source = streams.read_events(spark, str(tmp_path / "in"), "ts timestamp, kind string")
        held = {}

        def keep(df, i):
            held.update({(r.day, r.kind): r.n for r in df.collect()})

        streams.run_batches(streams.sliding_counts(source, "kind", "3 days", "1 day", "2 days"), str(tmp_path / "c"), keep, "update", name="topics")
        for _ in range(100):
            if late.dropped.get("topics"):
                break
            __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(late)
    want = collections.Counter()
    for d, k in [(0, "a"), (10, "a"), (11, "b"), (12, "a")]:
        for back in range(3):
            want[(START + datetime.timedelta(days=d - back)).date(), k] += 1
    assert held == dict(want) and late.dropped["topics"] >= 1


def chunked(df):
    """Pieces of ten characters; null texts give none."""
    return df.select("doc_id", F.posexplode(F.filter(F.transform(F.sequence(F.lit(0), F.length("text"), F.lit(10)), lambda i: F.substr("text", i + 1, F.lit(10))), lambda x: x != "")).alias("chunk_index", "chunk"))


def test_ingest_is_idempotent(spark, tmp_path):
    table = ChunkTable(spark, str(tmp_path / "table"), "doc_id", buckets=3)
    schema = "doc_id long, text string, version int"
    (tmp_path / "in").mkdir()

    def feed(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
        next((tmp_path / name).glob("*.parquet")).rename(tmp_path / "in" / f"{name}.parquet")
        ingest(streams.read_events(spark, str(tmp_path / "in"), schema), chunked, table, str(tmp_path / "checkpoint"), "version")

    texts = lambda: {i: "".join(r.chunk for r in rows) for i, rows in by_doc().items()}

    def by_doc():
        out = collections.defaultdict(list)
        for r in table.chunks().orderBy("doc_id", "chunk_index").collect():
            out[r.doc_id].append(r)
        return out

    states = lambda: {r.doc_id: (r.status, r.n_chunks, r.attempts) for r in table.states().collect()}
    assert table.chunks() is None and retry(table, spark.createDataFrame([], schema), chunked) == 0
    first = [(i, f"text of document {i} " * 2, 1) for i in range(9)] + [(3, "newer text of three", 2), (20, None, 1), (None, "no id", 1)]
    feed("first", first)
    want = {i: t for i, t, _ in sorted(first, key=lambda r: r[2]) if i is not None and t}
    assert texts() == want and states()[20] == ("error", 0, 1) and states()[3] == ("indexed", 2, 1)
    feed("again", first)  # the same rows a second time
    assert texts() == want and states()[20] == ("error", 0, 2)
    feed("changed", [(4, "short", 3), (30, "a new document", 1)])
    want |= {4: "short", 30: "a new document"}
    assert texts() == want and states()[4] == ("indexed", 1, 1)
    # a batch that comes again does nothing
    version = table.heads()
    table.put(spark.createDataFrame([(4, "other", 9)], schema), chunked, max(version.values()))
    assert texts() == want and table.heads() == version
    # a document in error is tried three times at most; then one that has been mended
    assert retry(table, spark.createDataFrame([(20, None, 1)], schema), chunked) == 1 and states()[20] == ("error", 0, 3)
    assert retry(table, spark.createDataFrame([(20, "mended", 1)], schema), chunked) == 0
    assert retry(table, spark.createDataFrame([(20, "mended", 1)], schema), chunked, most=5) == 1 and states()[20] == ("indexed", 1, 4)
    want[20] = "mended"
    table.vacuum()
    assert texts() == want


def test_a_batch_that_stops_midway_loses_nothing(spark, tmp_path, monkeypatch):
    table = ChunkTable(spark, str(tmp_path / "table"), "doc_id", buckets=2)
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    table.put(docs([(i, f"text {i}") for i in range(6)]), chunked, 1)
    write = ChunkTable._write

    def fails(self, rows, kind, version):
        write(self, rows, kind, version)
        if kind == "chunks":
            raise RuntimeError("stopped")

    monkeypatch.setattr(ChunkTable, "_write", fails)
    with pytest.raises(RuntimeError, match="stopped"):
        table.put(docs([(1, "changed")]), chunked, 2)
    monkeypatch.setattr(ChunkTable, "_write", write)
    assert {r.doc_id: r.chunk for r in table.chunks().collect()} == {i: f"text {i}" for i in range(6)}
    table.put(docs([(1, "changed")]), chunked, 2)
    assert {r.doc_id: r.chunk for r in table.chunks().collect()} == {i: f"text {i}" for i in range(6)} | {1: "changed"}


def test_new_documents_do_not_rewrite_old_ones(spark, tmp_path):
    table = ChunkTable(spark, str(tmp_path / "table"), "doc_id", buckets=1)
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    written = lambda v: {r.doc_id for r in spark.read.parquet(f"{table.folder}/chunks/version={v}").collect()}
    table.put(docs([(1, "one"), (2, "two")]), chunked, 1)
    table.put(docs([(3, "three")]), chunked, 2)
    assert written(2) == {3} and table.versions() == {0: [1, 2]}
    table.put(docs([(1, "changed"), (4, "four")]), chunked, 3)
    assert table.versions() == {0: [3]} and {r.doc_id: r.chunk for r in table.chunks().collect()} == {1: "changed", 2: "two", 3: "three", 4: "four"}
    assert {r.doc_id: r.attempts for r in table.states().collect()} == {1: 1, 2: 1, 3: 1, 4: 1}
