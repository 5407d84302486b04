"""Queries that run streams over the given tables to their end and return what they wrote."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import structure as C
from ..session import ship
from ..sources.tables import read_table as T
from ..streaming import streams as X
from ..streaming.conversation import conversation_turns
from ..streaming.upserts import ChunkTable, ingest
from .registry import query
from .retrieval import CACHE_SQL
from .shared import scratch


def stream_of(spark, sf, name, files=1):
    """The table as a stream of its files: one file, or a folder of them; so many a batch."""
    rows = T(spark, sf, name)
    folder = rows.inputFiles()[0].rsplit("/", 1)[0]
    return X.read_events(spark, folder, rows.schema, files, glob=None if folder.endswith(f"{name}.parquet") else f"{name}.parquet")


def events(spark, sf):
    return stream_of(spark, sf, "events")


def all_counts(spark, counts, kind, fields):
    """The counts of a stream in complete mode: each batch has all so far, so the last one's are the result."""
    out = scratch(spark, "streams")
    X.run_batches(counts, f"{out}/checkpoint", lambda df, i: df.write.mode("overwrite").parquet(f"{out}/rows/batch={i}"), "complete")
    rows = spark.read.schema(f"{fields}, batch int").parquet(f"{out}/rows")
    last = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == (last if last is not None else -1)).drop("batch").withColumn("report", F.lit(kind))


@query("stream_reports", """with s as (select cast(ts as date) - cast(i as int) as day, event_type, count(*) as n from events, range(30) r(i) group by all)
select 'daily' as report, cast(ts as date) as day, event_type, count(*) as n, cast(null as int) as rank from events group by all
union all select 'topics', day, event_type, n, cast(rank as int) from (select *, row_number() over (partition by day order by n desc, event_type) as rank from s) where rank <= 3""")
def _(spark, sf):
    daily = all_counts(spark, X.daily_counts(events(spark, sf), "event_type", "60 days"), "daily", "day date, event_type string, n long").withColumn("rank", F.lit(None).cast("int"))
    topics = all_counts(spark, X.sliding_counts(events(spark, sf), "event_type", watermark="60 days"), "topics", "day date, last_day date, event_type string, n long").drop("last_day")
    best = Window.partitionBy("day").orderBy(F.desc("n"), "event_type")
    topics = topics.withColumn("rank", F.row_number().over(best)).where("rank <= 3")
    return daily.unionByName(topics).select("report", "day", "event_type", "n", "rank")


@query("stream_cache", f"{CACHE_SQL} select event_id, user_id, event_type from kept")
def _(spark, sf):
    ship(spark)
    out = scratch(spark, "streams")
    X.run_once(X.first_answers(events(spark, sf)), f"{out}/rows", f"{out}/checkpoint")
    return spark.read.schema("event_id long, user_id long, event_type string").parquet(f"{out}/rows")


#: Sessions that the watermark, an hour before the last event, has passed.
SESSIONS_SQL = """with e as (select user_id, ts, sum(case when ts <= before + interval 30 minute then 0 else 1 end) over (partition by user_id order by ts) as i from (select user_id, ts, lag(ts) over (partition by user_id order by ts) as before from events)),
s as (select user_id, min(ts) as start, max(ts) + interval 30 minute as "end", count(*) as n from e group by user_id, i)
select user_id, epoch_us(start) as start_us, epoch_us("end") as end_us, n from s where "end" <= (select max(ts) from events) - interval 1 hour"""


@query("stream_sessions", SESSIONS_SQL)
def _(spark, sf):
    out = scratch(spark, "streams")
    X.run_once(X.sessions(events(spark, sf), "user_id"), f"{out}/rows", f"{out}/checkpoint")
    rows = spark.read.schema("user_id long, start timestamp, end timestamp, n long").parquet(f"{out}/rows")
    return rows.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("stream_question_answer", "select q.user_id, q.event_id as question_id, a.event_id as answer_id from events q join events a on q.user_id = a.user_id and q.event_type = 'view' and a.event_type = 'click' and a.ts >= q.ts and a.ts <= q.ts + interval 5 minute")
def _(spark, sf):
    out = scratch(spark, "streams")
    joined = X.answers_within(events(spark, sf).where("event_type = 'view'"), events(spark, sf).where("event_type = 'click'"), "user_id")
    X.run_once(joined, f"{out}/rows", f"{out}/checkpoint")
    return spark.read.schema("user_id long, question_id long, answer_id long").parquet(f"{out}/rows")


FIELDS = ["name", "year", "area"]
KINDS = {"signup": "open", "click": "answer", "purchase": "skip", "error": "cancel", "view": "ask"}

#: The same state machine, turn by turn: `done` fields have an answer or were skipped, `got` have an answer.
TURNS_SQL = f"""with recursive e as (select user_id, event_id, ts, event_type, cast(json_extract(props, '$.k') as int) >= 10 as fine, row_number() over (partition by user_id order by epoch_ms(ts), event_id) as i from events),
t as (select user_id, event_id, ts, i, case when event_type = 'signup' then 'form' else 'rag' end as mode, 0 as done, 0 as got, 0 as shown, case when event_type = 'signup' then 'asked' else 'idle' end as status from e where i = 1
  union all select user_id, event_id, ts, i, case when event_type = 'signup' and mode = 'rag' and done < {len(FIELDS)} then 'form' when mode = 'rag' then 'rag' when event_type = 'error' or filled = {len(FIELDS)} then 'rag' else 'form' end,
    case when filled = {len(FIELDS)} then 0 else filled end, case when filled = {len(FIELDS)} then 0 else gained end, gained,
    case when mode = 'rag' then case when event_type = 'signup' then 'asked' else 'idle' end when event_type = 'error' then 'cancelled' when event_type = 'view' then 'digression' when event_type = 'click' and not fine then 'invalid' when filled = {len(FIELDS)} then 'complete' else 'asked' end
  from (select e.user_id, e.event_id, e.ts, e.i, e.event_type, e.fine, s.mode, s.done, s.done + (s.mode = 'form' and (e.event_type = 'purchase' or (e.event_type = 'click' and e.fine)))::int as filled, s.got + (s.mode = 'form' and e.event_type = 'click' and e.fine)::int as gained
    from (select t.user_id, t.i, case when idle then 'rag' else t.mode end as mode, case when idle then 0 else done end as done, case when idle then 0 else got end as got from (select t.*, epoch_ms(n.ts) - epoch_ms(t.ts) > 21600000 as idle from t join e n on n.user_id = t.user_id and n.i = t.i + 1) t) s
    join e on e.user_id = s.user_id and e.i = s.i + 1))
select user_id, event_id, mode, case when mode = 'form' then [{", ".join(f"'{f}'" for f in FIELDS)}][done + 1] end as asked, cast(shown as int) as collected, status from t"""


@query("stream_conversation", TURNS_SQL)
def _(spark, sf):
    ship(spark)
    out = scratch(spark, "streams")
    kind = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))[F.col("event_type")]
    turns = events(spark, sf).select("user_id", "event_id", "ts", kind.alias("kind"), F.get_json_object("props", "$.k").alias("value"))
    X.run_once(conversation_turns(turns, "user_id", FIELDS, lambda field, value: int(value) >= 10, 6 * 3_600_000, "6 hours"), f"{out}/rows", f"{out}/checkpoint")
    return spark.read.schema("user_id long, event_id long, mode string, asked string, collected int, status string").parquet(f"{out}/rows")


@query("stream_ingest", "select doc_id, cast(row_number() over (partition by doc_id order by s) - 1 as int) as chunk_index from (select doc_id, substring(text, cast(s as int) + 1, 900) as p, s from (select doc_id, text, unnest(range(0, greatest(length(text) - 121, 0) + 1, 780)) as s from documents)) where length(trim(p)) >= 60")
def _(spark, sf):
    out = scratch(spark, "streams")
    table = ChunkTable(spark, f"{out}/table", "doc_id")
    chunk = lambda df: C.chunk_documents(df.withColumn("name", F.lit("file")), "doc_id", "text", "name", clean=False, fallback="windows")
    ingest(stream_of(spark, sf, "documents", 16), chunk, table, f"{out}/checkpoint")
    return table.chunks().select("doc_id", "chunk_index")
