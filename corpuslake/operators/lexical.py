"""Lexical search: a kept inverted index, BM25 by questions' scopes, and the overlap of words where BM25 finds nothing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import tokens
from ..session import shared_dir, ship

K1, B, EPSILON = 1.5, 0.75, 0.25
BUCKETS = 32
#: A file of postings holds so many at most, and a bucket of terms stands for so many postings at most.
PART_POSTINGS, BUCKET_POSTINGS = 2_000_000, 8_000_000
BROADCAST_ROWS = 500_000
#: Up to so many groups, an index keeps the document frequencies of each; beyond, a table of terms by group would be about as large as the postings.
GROUPS = 1024
#: The group that stands for all documents in terms and totals.
ALL = "*"


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has at most so many rows; else Spark joins by a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


class LexicalIndex(NamedTuple):
    """A written index. postings: term, key, grp, tf, dl, head (one of each chunk), in segments as the tasks that tokenised wrote them, those of a chunk side by side, so that nothing of them
    is shuffled and a search adds up a chunk's score where it reads it; terms: term, grp, df, cf, raw (idf before its floor), bucketed and sorted by term; totals: grp, n, avgdl, mean (of
    raw). grp "*" stands for all documents. by_group: terms has the groups too; where there are over GROUPS of them, a search counts the terms of those that it looks at."""

    folder: str
    name: str
    key: str
    buckets: int
    by_group: bool = True

    def table(self, spark: SparkSession, kind: str) -> DataFrame:
        if not spark.catalog.tableExists(f"{self.name}_{kind}"):  # another session wrote it
            schema = spark.read.parquet(f"{self.folder}/{kind}").schema
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
            by = f"clustered by (term) sorted by (term) into {self.buckets} buckets" if kind == "terms" else ""
            spark.sql(f"create table {self.name}_{kind} ({columns}) using parquet {by} location '{self.folder}/{kind}'")
        return spark.table(f"{self.name}_{kind}")

    def postings(self, spark: SparkSession) -> DataFrame:
        return self.table(spark, "postings")

    def terms(self, spark: SparkSession) -> DataFrame:
        return self.table(spark, "terms")

    def totals(self, spark: SparkSession) -> DataFrame:
        return self.table(spark, "totals")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of rows (key, grp, words): a chunk's words are counted as numbers of the batch's vocabulary."""
    stop = pa.array(rules.STOP_WORDS, pa.string())
    for batch in batches:
        words = batch.column(2)
        coded = pc.list_flatten(words).dictionary_encode()
        terms, ids, rows = coded.dictionary, coded.indices.to_numpy(), pc.list_parent_indices(words).to_numpy()
        kept = ~pc.is_in(terms, stop).to_numpy(zero_copy_only=False)[ids]
        ids, rows = ids[kept].astype(np.int64), rows[kept].astype(np.int64)
        pairs, tf = np.unique(rows * max(len(terms), 1) + ids, return_counts=True)
        row, term = np.divmod(pairs, max(len(terms), 1))
        head = np.ones(len(row), bool)
        head[1:] = row[1:] != row[:-1]
        dl = np.bincount(rows, minlength=batch.num_rows).astype(np.int64)[row]
        columns = [terms.take(pa.array(term)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(tf.astype(np.int64)), pa.array(dl), pa.array(head)]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "key", "grp", "tf", "dl", "head"])


def postings_of(chunks: DataFrame, key: str, texts: list[str], group: str | None = None) -> DataFrame:
    """term, key, grp, tf, dl, head of the words of some text columns, read one after the other; dl is the number of words of the chunk, head marks one
    posting of each chunk. Counted batch by batch, so that nothing is shuffled."""
    ship(chunks.sparkSession)
    grp = F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit("")
    rows = chunks.select(F.col(key).alias("key"), grp.alias("grp"), tokens(F.concat_ws(" ", *texts), []).alias("w"))
    return rows.mapInArrow(_counted, f"term string, key {rows.schema['key'].dataType.simpleString()}, grp string, tf long, dl long, head boolean")


def _write(postings: DataFrame, key: str, folder: str | None, buckets: int) -> LexicalIndex:
    spark = postings.sparkSession
    made = uuid.uuid4().hex
    folder, name = folder or f"{shared_dir(spark)}/corpuslake/lexical-{made}", f"lexical_{made}"
    postings.write.option("maxRecordsPerFile", PART_POSTINGS).option("compression", "zstd").option("path", f"{folder}/postings").saveAsTable(f"{name}_postings")
    held = spark.table(f"{name}_postings")
    buckets = max(buckets, -(-held.count() // BUCKET_POSTINGS))
    totals = held.where("head").groupBy("grp").agg(F.count("*").alias("n"), F.sum("dl").alias("words"))
    groups = totals.limit(GROUPS + 1).count()
    out = LexicalIndex(folder, name, key, buckets, groups <= GROUPS)
    every = totals.agg(F.lit(ALL).alias("grp"), F.sum("n").alias("n"), F.sum("words").alias("words")).where("n is not null")
    counts = (F.count("*").alias("df"), F.sum("tf").alias("cf"))
    if groups < 2:  # one group is all
        counted = held.groupBy("term", "grp").agg(*counts).withColumn("grp", F.explode(F.array("grp", F.lit(ALL))))
    elif out.by_group:
        counted = held.groupBy("term", "grp").agg(*counts)
        counted = counted.unionByName(counted.groupBy("term").agg(F.lit(ALL).alias("grp"), F.sum("df").alias("df"), F.sum("cf").alias("cf")))
    else:
        counted = held.groupBy("term").agg(F.lit(ALL).alias("grp"), *counts)
    sizes = totals.unionByName(every)
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    terms = counted.join(few(sizes) if out.by_group else F.broadcast(every), "grp").select("term", "grp", "df", "cf", raw.alias("raw"))
    terms.repartition(buckets, "term").sortWithinPartitions("term").write.bucketBy(buckets, "term").sortBy("term").option("path", f"{out.folder}/terms").saveAsTable(f"{out.name}_terms")
    mean = out.terms(spark).groupBy("grp").agg(F.avg("raw").alias("mean"))
    sizes.join(F.broadcast(mean), "grp", "left").select("grp", "n", (F.col("words") / F.col("n")).alias("avgdl"), "words", "mean").write.option("path", f"{out.folder}/totals").saveAsTable(f"{out.name}_totals")
    return out


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def write_lexical_index(chunks: DataFrame, key: str, texts: list[str], group: str | None = None, folder: str | None = None, buckets: int = BUCKETS) -> LexicalIndex:
    """Tokenise chunks once and keep their index; group: a column whose values questions may ask for. Chunks without words have no postings."""
    return _write(postings_of(chunks, key, texts, group), key, folder, buckets)


def reindexed(spark: SparkSession, index: LexicalIndex, gone: DataFrame, added: DataFrame, texts: list[str], group: str | None = None) -> LexicalIndex:
    """A new index without the chunks of gone (their keys in the index's key column) and with those of added; only these are tokenised. A changed chunk stands in both."""
    kept = index.postings(spark).join(gone.select(F.col(index.key).alias("key")), "key", "left_anti")
    return _write(kept.unionByName(postings_of(added, index.key, texts, group)), index.key, None, index.buckets)


def drop_index(spark: SparkSession, index: LexicalIndex) -> None:
    for kind in ("postings", "terms", "totals"):
        spark.sql(f"drop table if exists {index.name}_{kind}")
    remove(spark, index.folder)


def _asked(questions: DataFrame, question_key: str, text: str, scope: str | None) -> DataFrame:
    """question, term, qtf, scope, s (the scope as a text)."""
    sets = F.array_sort(F.array_distinct(F.transform(scope, lambda x: F.coalesce(x.cast("string"), F.lit(""))))) if scope else F.lit(None).cast("array<string>")
    rows = questions.select(F.col(question_key).alias("question"), sets.alias("scope"), F.explode(tokens(F.col(text))).alias("term"))
    return rows.groupBy("question", "term", "scope").agg(F.count("*").alias("qtf")).withColumn("s", F.coalesce(F.to_json("scope"), F.lit(ALL)))


def _held(df: DataFrame, index: LexicalIndex) -> DataFrame:
    """df, written once into the index's folder: for what a search uses several times."""
    path = f"{index.folder}/search-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _terms(spark: SparkSession, index: LexicalIndex, members: DataFrame) -> DataFrame:
    """term, grp, df: as the index keeps them, or, where it keeps no groups, those of all and of the groups that scopes have, counted in one reading of the postings."""
    terms = index.terms(spark).select("term", "grp", "df")
    if index.by_group:
        return terms
    groups = few(members.where(F.col("grp") != ALL).select("grp").distinct())
    return terms.unionByName(_held(index.postings(spark).join(groups, "grp").groupBy("term", "grp").agg(F.count("*").alias("df")), index))


def _weights(spark: SparkSession, asked: DataFrame, index: LexicalIndex) -> DataFrame:
    """s, term, avgdl, idf for the terms asked in each scope.

    Scopes of all documents or of one group have their totals in the index; those of several groups are added up, and so are those of one where the index keeps no terms of groups."""
    scopes = asked.select("s", "scope").distinct()
    members = scopes.select("s", F.explode(F.coalesce("scope", F.array(F.lit(ALL)))).alias("grp"), ((F.coalesce(F.size("scope"), F.lit(1)) > 1) if index.by_group else F.col("scope").isNotNull()).alias("many"))
    members = few(members)
    totals, terms = index.totals(spark), _terms(spark, index, members)
    sums = totals.join(members, "grp").groupBy("s").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.max("mean").alias("one"), F.max("many").alias("many"))
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    joint = terms.join(few(members.where("many")), "grp").groupBy("term", "s").agg(F.sum("df").alias("df"))
    means = joint.join(few(sums.select("s", "n")), "s").groupBy("s").agg(F.avg(raw).alias("joint"))
    sums = few(sums.join(means, "s", "left").select("s", "n", (F.col("words") / F.col("n")).alias("avgdl"), F.when(F.col("many"), F.col("joint")).otherwise(F.col("one")).alias("mean")))
    wanted = asked.select("term", "s").distinct().join(members.drop("many"), "s")
    found = terms.join(few(wanted), ["term", "grp"]).groupBy("term", "s").agg(F.sum("df").alias("df")).join(sums, "s").withColumn("raw", raw)
    return found.select("s", "term", "avgdl", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def _matches(spark: SparkSession, asked: DataFrame, index: LexicalIndex) -> DataFrame:
    """The postings of asked terms within their questions' scopes; the asked rows come to the postings, for many small groups by group and term."""
    if index.by_group:
        rows = index.postings(spark).join(few(asked), "term")
        return rows.where(F.col("scope").isNull() | F.array_contains("scope", F.col("grp")))
    inside = index.postings(spark).join(few(asked.withColumn("grp", F.explode("scope"))), ["grp", "term"])
    return inside.unionByName(index.postings(spark).join(few(asked.where("scope is null")), "term"))


def bm25_hits(questions: DataFrame, index: LexicalIndex, question_key: str, text: str, scope: str | None = None) -> DataFrame:
    """question_key, key, score (Okapi BM25, six decimals) of all chunks above 0.

    scope: a column of questions with the groups it looks at (null: all); lengths, document frequencies and their mean are then those of its groups alone.
    Question words count as often as they stand; a word in more than half of the chunks has a quarter of the mean idf."""
    spark = questions.sparkSession
    asked = _asked(questions, question_key, text, scope)
    weighed = asked.join(_weights(spark, asked, index), ["s", "term"])
    weighed = weighed if index.by_group else _held(weighed, index)
    weight = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    rows = _matches(spark, weighed, index).groupBy("question", "key").agg(F.round(F.sum(weight), 6).alias("score"))
    return rows.where("score > 0").select(F.col("question").alias(question_key), F.col("key").alias(index.key), "score")


def overlap_hits(questions: DataFrame, index: LexicalIndex, question_key: str, text: str, scope: str | None = None) -> DataFrame:
    """question_key, key, score: the share of a question's distinct words that a chunk has, in its scope."""
    spark = questions.sparkSession
    asked = _asked(questions, question_key, text, scope)
    asked = asked.join(few(asked.groupBy("question").agg(F.count("*").alias("words"))), "question")
    rows = _matches(spark, asked, index).groupBy("question", "key", "words").agg(F.count("*").alias("m"))
    return rows.select(F.col("question").alias(question_key), F.col("key").alias(index.key), F.round(F.col("m") / F.col("words"), 6).alias("score"))


def lexical_hits(questions: DataFrame, index: LexicalIndex, question_key: str, text: str, scope: str | None = None) -> DataFrame:
    """bm25_hits(), and for the questions whose best BM25 is not above 0, overlap_hits(); by tells which."""
    found = bm25_hits(questions, index, question_key, text, scope).withColumn("by", F.lit("bm25"))
    rest = questions.join(found.select(question_key).distinct(), question_key, "left_anti")
    rest = rest if index.by_group else _held(rest.select(question_key, text, *([scope] if scope else [])), index)  # as those asked anew are joined several times
    return found.unionByName(overlap_hits(rest, index, question_key, text, scope).withColumn("by", F.lit("overlap")))
