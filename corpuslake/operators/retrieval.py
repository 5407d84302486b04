"""Batched retrieval: a table of questions against a table of texts or vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules
from ..functions.text import first_match, tokens
from ..session import ship
from .lexical import LexicalIndex, lexical_hits
from .scorers import rerank, score_pairs, shared_words
from .vectors import DENSE_K, THRESHOLD, dense_topk

#: Retrieval sizes and weights of production settings.
TOP_K, LEXICAL_K, RERANK_K, RRF_K = 6, 20, 3, 60


def detect_intent(question):
    return first_match(F.lower(question), rules.INTENTS, "general")


def expand_query(question, rewrite):
    """The question, with its rewritten form unless it has a legal term already or the form is short."""
    legal = reduce(lambda a, b: a | b, [F.lower(question).contains(t) for t in rules.LEGAL_TERMS])
    return F.when(legal | rewrite.isNull() | (F.length(rewrite) <= 5), question).otherwise(F.concat_ws(" ", question, rewrite))


def top(hits: DataFrame, question_key: str, key: str, k: int, score: str = "score", rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(question_key).orderBy(F.desc(score), key)
    return hits.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def rrf_fuse(dense: DataFrame, lexical: DataFrame, question_key: str, key: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion: 1 / (k + rank) summed over both lists, against the best sum there can be."""
    d = dense.select(question_key, key, F.col("rank").alias("dense_rank"))
    x = lexical.select(question_key, key, F.col("rank").alias("lexical_rank"))
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    score = F.round(F.least(F.lit(1.0), (part("dense_rank") + part("lexical_rank")) / (2.0 / (k + 1))), 6)
    return d.join(x, [question_key, key], "full_outer").withColumn("score", score)


def weighted_fuse(dense: DataFrame, lexical: DataFrame, question_key: str, key: str, weight: float = 0.65) -> DataFrame:
    """weight parts of the dense score and the rest of the lexical one, each against the best of its question (halves of the last digit go up)."""
    best = lambda df, name: df.select(question_key, key, F.when(F.max("score").over(Window.partitionBy(question_key)) > 0, F.col("score") / F.max("score").over(Window.partitionBy(question_key))).otherwise(0.0).alias(name))
    joined = best(dense, "d").join(best(lexical, "x"), [question_key, key], "full_outer")
    return joined.select(question_key, key, F.round(weight * F.coalesce("d", F.lit(0.0)) + (1 - weight) * F.coalesce("x", F.lit(0.0)) + 1e-9, 6).alias("score"))


#: Ways to fuse a dense and a lexical list, by name.
FUSIONS: dict[str, Callable] = {"rrf": rrf_fuse, "weighted": weighted_fuse}


def retrieve(questions: DataFrame, vectors: DataFrame, index: LexicalIndex, chunks: DataFrame, question_key: str, key: str, threshold: float = THRESHOLD, fusion: str = "rrf", scorer: Callable | None = shared_words, top_k: int = TOP_K, rerank_k: int = RERANK_K) -> DataFrame:
    """The whole chain for a table of questions (question_key, text, rewrite, embedding, scope): a row (question_key, key, score, rank, and chunks' columns) for each of the
    rerank_k best chunks.

    1. The question is expanded by its rewrite. 2. Its vector is looked up in vectors (key, embedding, grp) and its words in the kept index, both only in
    the groups of its scope (an array of texts; null: all). 3. The lists are fused (a name of FUSIONS) and the top_k best stay. 4. The scorer's value for
    the question and the chunk's text is blended in, if there is one. A question that finds nothing has no row: see fallback_answers()."""
    asked = questions.withColumn("query", expand_query(F.col("text"), F.col("rewrite")))
    dense = dense_topk(asked, vectors, question_key, key, "embedding", DENSE_K, threshold, scope="scope", group="grp")
    lexical = top(lexical_hits(asked, index, question_key, "query", "scope"), question_key, key, LEXICAL_K)
    found = top(FUSIONS[fusion](dense, lexical, question_key, key), question_key, key, max(top_k, rerank_k)).select(question_key, key, "score")
    rows = found.join(chunks, key).join(questions.select(question_key, F.col("text").alias("_question")), question_key)
    if scorer:
        rows = score_pairs(rows, "_question", "text", scorer)
    return rerank(rows, question_key, key, rerank_k, "ce_score" if scorer else None).drop("_question")


def build_context(hits: DataFrame, question_key: str) -> DataFrame:
    """question_key, context: numbered blocks of the hits (rank, source_name, article, clause, status, text)."""
    label = reduce(lambda c, kv: c.when(F.col("status") == kv[0], kv[1]), rules.STATUS_LABELS.items(), F.when(F.lit(False), "")).otherwise(F.coalesce(F.col("status"), F.lit(rules.STATUS_LABELS["active"])))
    filled = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(", "), F.col(c))).otherwise("")
    block = F.concat(F.lit("--- Tài liệu "), F.col("rank").cast("string"), F.lit(" ["), F.col("source_name"), filled("article"), filled("clause"), F.lit(" — "), label, F.lit("] ---\n"), F.col("text"))
    blocks = F.sort_array(F.collect_list(F.struct("rank", block.alias("b"))))
    return hits.groupBy(question_key).agg(F.array_join(F.transform(blocks, lambda x: x["b"]), "\n\n").alias("context"))


def cite(answers: DataFrame, hits: DataFrame, question_key: str, least: float = 0.08) -> DataFrame:
    """Hits (rank, score, text) that support an answer, with support and relevance; without any, the first hit with support 0."""
    a = answers.select(question_key, F.array_distinct(tokens(F.col("answer"))).alias("_a"))
    rows = hits.join(a, question_key).withColumn("_t", F.array_distinct(tokens(F.col("text"))))
    support = F.size(F.array_intersect("_a", "_t")) / F.greatest(F.size("_a"), F.lit(1))
    rows = rows.withColumn("support", support).withColumn("_any", F.max(F.col("support") >= least).over(Window.partitionBy(question_key)))
    rows = rows.where((F.col("support") >= least) | (~F.col("_any") & (F.col("rank") == 1))).withColumn("support", F.when(F.col("_any"), F.col("support")).otherwise(0.0))
    return rows.withColumn("relevance", F.bround(0.7 * F.col("score") + 0.3 * F.col("support"), 3)).drop("_a", "_t", "_any")


def confidence(answers: DataFrame, hits: DataFrame, cited: DataFrame, question_key: str) -> DataFrame:
    """question_key, confidence from the best hit, the answer's grounding in what is cited, and the cited share of the hits."""
    top_ = hits.groupBy(question_key).agg(F.max_by("score", -F.col("rank")).alias("best"), F.count("*").alias("n"))
    words = cited.groupBy(question_key).agg(F.array_distinct(F.flatten(F.collect_list(tokens(F.col("text"))))).alias("_w"), F.count("*").alias("cited"))
    rows = answers.join(top_, question_key, "left").join(words, question_key, "left").withColumn("_a", F.array_distinct(tokens(F.col("answer"))))
    fallback = reduce(lambda a, b: a | b, [F.lower("answer").contains(p) for p in rules.FALLBACK_PHRASES])
    grounding = F.coalesce(F.size(F.array_intersect("_a", "_w")), F.lit(0)) / F.greatest(F.size("_a"), F.lit(1))
    value = F.bround(F.least(F.lit(0.99), 0.55 * F.col("best") + 0.35 * grounding + 0.10 * F.coalesce("cited", F.lit(0)) / F.col("n")), 3)
    return rows.select(question_key, F.when(F.col("best").isNull(), 0.0).when(fallback, F.least(F.col("best") * 0.5, F.lit(0.4))).otherwise(value).alias("confidence"))


def fallback_answers(questions: DataFrame, hits: DataFrame, question_key: str, answer: str) -> DataFrame:
    """A fallback row for each question without a hit."""
    return questions.join(hits, question_key, "left_anti").select(question_key, F.lit(answer).alias("answer"), F.lit(True).alias("is_fallback"), F.lit(0.0).alias("confidence"))


def excerpt_answers(failed: DataFrame, hits: DataFrame, question_key: str, text: str, rank: str = "rank", n: int = 2, size: int = 900) -> DataFrame:
    """An answer of excerpts for each question whose answer failed although there are hits: the first size characters of the texts of its n best
    hits, blank ones left out."""
    best = hits.where(F.col(rank) <= n).join(failed.select(question_key), question_key, "left_semi")
    parts = F.sort_array(F.collect_list(F.when(F.trim(text) != "", F.struct(rank, F.substring(F.trim(text), 1, size).alias("_t")))))
    excerpts = F.array_join(F.transform(parts, lambda x: F.concat(F.lit("• "), x["_t"])), "\n\n")
    answer = F.concat(F.lit(rules.EXCERPTS_BEFORE), excerpts, F.lit(rules.EXCERPTS_AFTER))
    return best.groupBy(question_key).agg(answer.alias("answer")).select(question_key, "answer", F.lit(True).alias("is_fallback"), F.lit(0.0).alias("confidence"))


def _reused(key: int, ts: int, ttl_us: int) -> Callable:
    """Rows sorted by key and time, with `reused`; only the last answer stored is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, stored = object(), None
        for batch in batches:
            flags = []
            for k, t in zip(batch.column(key).to_pylist(), batch.column(ts).cast(pa.int64()).to_pylist(), strict=True):
                if k != last:
                    last, stored = k, None
                fits = t is not None and stored is not None and t <= stored + ttl_us
                flags.append(fits)
                if not fits and t is not None:
                    stored = t
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flags, pa.bool_())], names=[*batch.schema.names, "reused"])

    return run


def reuse_answers(log: DataFrame, key: str, ts: str, order: str, ttl_hours: float = 6) -> DataFrame:
    """log with `reused`: whether an answer stored for the key at most ttl_hours before is there. An answer that is reused is not stored again, so its
    time does not start anew. A row without a time is neither. Rows are dealt by key and sorted; a key's rows stream through a task."""
    ship(log.sparkSession)
    rows = log.repartition(key).sortWithinPartitions(key, ts, order)
    schema = T.StructType([*log.schema.fields, T.StructField("reused", T.BooleanType())])
    return rows.mapInArrow(_reused(log.columns.index(key), log.columns.index(ts), int(ttl_hours * 3_600_000_000)), schema)


def suggest(log: DataFrame, asked: DataFrame, group: str, question: str, k: int = 5) -> DataFrame:
    """asked, with a row (question, n, rank) for each of the k questions that stand most often in the log of its group; in that of all groups where
    its own has none."""
    counts = log.where(F.col(group).isNotNull()).groupBy(group, question).agg(F.count("*").alias("n"))
    everyone = counts.groupBy(question).agg(F.sum("n").alias("n")).withColumn(group, F.lit(None).cast(log.schema[group].dataType))
    lists = counts.unionByName(everyone)
    best = Window.partitionBy(group).orderBy(F.desc("n"), question)
    lists = lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).withColumnRenamed(group, "_group")
    known = counts.select(F.col(group).alias("_known")).distinct()
    rows = asked.join(known, F.col(group) == F.col("_known"), "left")
    return rows.join(lists, F.col("_known").eqNullSafe(F.col("_group"))).select(*asked.columns, question, "n", "rank")
