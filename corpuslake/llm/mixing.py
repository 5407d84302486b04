"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, hinted, written

ROWS_A_BUCKET = 5_000
WORD = r"[^\x20\x09-\x0D]+"


def word_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: the number of runs of bytes that are not ASCII white space."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("size"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """source, source_size, target: share x all sizes dealt by weight; no target is above repeats x its source's size. One row a source meets in a task.

    Sources take the weights by code point, null last, repeating. A source whose part would exceed its cap gets the cap, and the
    rest is dealt again: with sources sorted by cap / weight, that is the first level at which no later source is capped.
    """
    all_ = Window.partitionBy()
    by_name = all_.orderBy(F.col("source").asc_nulls_last())
    by_ratio = all_.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("weight", weight).withColumn("cap", F.col("source_size") * repeats)
    s = s.withColumn("capped_before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("weight_left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.lit(share) * F.sum("source_size").over(all_) - F.col("capped_before")) / F.col("weight_left"))
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(all_)
    s = s.withColumn("level", F.coalesce(level, F.lit(float("inf"))))
    return s.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def queue(sizes: DataFrame, goals: DataFrame, repeats: int, seed: str) -> DataFrame:
    """A row for each copy in the queue, with its virtual finish time: the words of its source up to its end, divided by the source's target.

    Within a source, documents stand in a seeded random order (md5 of seed and doc_id), once per repeat. The cumulative sums have two levels,
    hash buckets within a source and rows within a bucket, so a source with most rows is spread over as many tasks as its rows need; only
    totals of buckets meet per source. row tells rows apart that are equal in all columns."""
    n = sizes.select(F.count("*")).first()[0]
    buckets = max(1, n // ROWS_A_BUCKET)
    order = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sizes = sizes.withColumn("place", order).withColumn("bucket", F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("double") / F.lit(2.0**32) * buckets).cast("long"))
    within = Window.partitionBy("source", "bucket").orderBy("place", "doc_id", "size")
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("s")).select(F.col("source").alias("src"), F.col("bucket").alias("b"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    rows = sizes.withColumn("row", F.row_number().over(within)).withColumn("inner", F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.join(totals, F.col("source").eqNullSafe(F.col("src")) & (F.col("bucket") == F.col("b"))).join(hinted(goals, 64), F.col("source").eqNullSafe(F.col("goal_source")))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    end = F.col("base") + F.col("inner") + F.col("size") + F.col("source_size") * F.col("copy")
    return rows.select("doc_id", "size", "source", "source_size", "target", "place", "bucket", "row", "copy", F.try_divide(end.cast("double"), F.col("target")).alias("finish"))


def serve(copies: DataFrame, budget: int, partitions: int | None = None) -> DataFrame:
    """The queue as served: copies sorted by virtual finish time over range partitions (`range` is the partition), and the words taken of each before the
    total budget is spent. Each range is summed by itself; only the ranges' totals meet."""
    n = partitions or int(copies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("finish").asc_nulls_last(), F.col("source").asc_nulls_last(), "place", "doc_id", "size", "row", "copy"]
    dealt = written(copies.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()), "queue")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("range").agg(F.sum("size").alias("s")).select("range", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0))
    return dealt.join(F.broadcast(totals), "range").withColumn("taken", F.greatest(F.lit(0), F.least(F.col("size"), F.lit(budget) - start)))


def mix_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, repeats: int = 2, seed: str = "mix") -> DataFrame:
    """doc_id, size, source, source_size, target, taken for each row of docs: how many words of it the mix takes, repeats counted.

    Weighted fair queueing: every copy of a document gets its virtual finish time (see queue()); copies are range-sorted by it over all sources
    and served until the total budget, the sum of the targets rounded down, is spent. At time 1 every source has had its target, so its taken
    words differ from it by the documents then being served. The last copy served is taken in part.
    Null or blank text has size 0 and takes nothing. A null source is a source. Rows that share a doc_id stand next to each other;
    repeated rows count each. An empty table gives no rows. Other columns are not read.
    """
    sizes = written(word_sizes(docs), "sizes")
    goals = written(source_targets(sizes, weights, share, repeats).withColumnRenamed("source", "goal_source"), "targets")
    budget = int(goals.agg(F.floor(F.sum("target"))).first()[0] or 0)
    served = serve(queue(sizes, goals, repeats, seed), budget)
    return served.groupBy("source", "bucket", "row", "place", "doc_id", "size", "source_size", "target").agg(F.sum("taken").cast("long").alias("taken")).select("doc_id", "size", "source", "source_size", "target", "taken")


def apply_mix(docs: DataFrame, repeats: int = 2, **options) -> DataFrame:
    """docs as the mix takes them, with its own columns: a row for each whole copy, and one cut after the words taken in part (n_chars, where there is
    such a column, then counts the rest).

    Documents of which no word is taken go, so null and blank texts do. Rows that share doc_id, source and size are one group: its words go
    to its rows in the order of their texts. Null doc_ids and null sources are groups too. An empty table gives no rows. Columns may have
    any names. Texts stay where they are while decisions are few enough to broadcast (see hinted())."""
    id_, source, size, taken, rows, own, turn, part = (fresh(x, docs) for x in ("id_", "source_", "size_", "taken_", "rows_", "own_", "turn_", "part_"))
    mixed = mix_documents(docs, repeats=repeats, **options).groupBy(F.col("doc_id").alias(id_), F.col("source").alias(source), F.col("size").alias(size))
    mixed = written(mixed.agg(F.sum("taken").alias(taken), F.count("*").alias(rows)).where(F.col(taken) > 0), "mixed")
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.withColumn(own, F.regexp_count(text, F.lit(WORD)).cast("long"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & F.col("source").cast("string").eqNullSafe(F.col(source)) & (F.col(own) == F.col(size))
    out = marked.join(hinted(mixed.where(F.col(rows) == 1), 64), same)
    repeated = mixed.where(F.col(rows) > 1)
    if not repeated.isEmpty():
        nth = F.row_number().over(Window.partitionBy(id_, source, size).orderBy(F.md5(text), F.xxhash64(*docs.columns))) - 1
        left = F.least(F.col(taken) - nth * F.col(size) * repeats, F.col(size) * repeats)
        out = out.unionByName(marked.join(hinted(repeated, 64), same).withColumn(taken, left).where(F.col(taken) > 0))
    copies = F.transform(F.sequence(F.lit(0), F.floor((F.col(taken) - 1) / F.col(size)).cast("int")), lambda i: F.least(F.col(size), F.col(taken) - i * F.col(size)))
    out = out.withColumn(turn, F.explode(copies)).withColumn(part, F.col(turn) < F.col(size))
    cut = F.when(F.col(part), F.array_join(F.slice(F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), 1, F.col(turn).cast("int")), "")).otherwise(F.col("text"))
    out = out.withColumn("text", cut)
    return (out.withColumn("n_chars", F.when(F.col(part), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else out).select(*docs.columns)


def mixing_query(docs: DataFrame) -> DataFrame:
    return mix_documents(docs).select("doc_id", "size", "source_size", "target", "taken")


MIXING_SQL = r"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size, md5('mix' || cast(doc_id as varchar)) as place from documents),
s as (select source, cast(sum(size) as bigint) as source_size, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight from d group by source),
c as (select *, source_size * 2 as cap, cast(source_size * 2 as double) / weight as ratio from s),
l as (select *, (1.5 * cast(sum(source_size) over () as double) - cast(coalesce(sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0) as double))
        / cast(sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following) as double) as level from c),
t as (select source, source_size, least(cast(cap as double), coalesce(max(case when level * weight <= cap then level end) over (), cast('inf' as double)) * weight) as target from l),
q as (select d.*, t.source_size, t.target, row_number() over w as row, coalesce(sum(d.size) over (w rows between unbounded preceding and 1 preceding), 0) as start
      from d join t on d.source is not distinct from t.source window w as (partition by d.source order by d.place, d.doc_id, d.size)),
c2 as (select *, cast(start + size + source_size * copy as double) / target as finish from q, (values (0), (1)) v(copy)),
s2 as (select *, coalesce(sum(size) over (order by finish nulls last, source nulls last, place, doc_id nulls first, size, row, copy rows between unbounded preceding and 1 preceding), 0) as before from c2)
select doc_id, size, source_size, target, cast(sum(greatest(0, least(size, (select floor(sum(target)) from t) - before))) as bigint) as taken
from s2 group by source, place, doc_id, size, row, source_size, target
"""
