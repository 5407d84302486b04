"""Answer evaluation: scores of cases, verdicts, summaries of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import eval_tokens, token_coverage, token_jaccard


def run_summary(scores: DataFrame, run: str, valid: Column, value: Column, threshold: float, over_valid: dict[str, Column] | None = None, over_all: dict[str, Column] | None = None) -> DataFrame:
    """Per run: rows, valid rows that reach the threshold, the mean over valid rows and over all; and further means over valid rows (grounding,
    recall, confidence, a condition's share as of citations) and over all (latency)."""
    mean = lambda c: F.round(F.avg(c.cast("double")), 4)
    more = [mean(F.when(valid, c)).alias(n) for n, c in (over_valid or {}).items()] + [mean(c).alias(n) for n, c in (over_all or {}).items()]
    return scores.groupBy(run).agg(F.count("*").alias("total"), F.count_if(valid & (value >= threshold)).alias("passed"), F.round(F.avg(F.when(valid, value)), 4).alias("mean_valid"), F.round(F.avg(value), 4).alias("mean_all"), *more)


def run_metrics(scores: DataFrame, run: str, valid: Column, fallback: Column, threshold: float = 0.4) -> DataFrame:
    """run_summary() of case_scores() with grounding, recall, citation_rate, and two rates that are told apart: ungrounded_rate, the part of
    answers that no context covers, and fallback_rate, the share of fallback answers."""
    means = {"grounding": F.col("grounding"), "recall": F.col("recall"), "citation_rate": F.col("has_citation"), "ungrounded_rate": 1 - F.col("grounding"), "fallback_rate": fallback}
    return run_summary(scores, run, valid, F.col("similarity"), threshold, means)


def case_scores(cases: DataFrame) -> DataFrame:
    """cases (answer, expected, context, and citations (array) if it is there) with similarity, grounding, recall and has_citation."""
    tokens = cases.withColumn("_a", eval_tokens(F.col("answer"))).withColumn("_e", eval_tokens(F.col("expected"))).withColumn("_c", eval_tokens(F.col("context")))
    scored = tokens.withColumn("similarity", token_jaccard(F.col("_a"), F.col("_e"))).withColumn("grounding", token_coverage(F.col("_a"), F.col("_c"))).withColumn("recall", token_coverage(F.col("_e"), F.col("_c")))
    cited = F.coalesce(F.size("citations") > 0, F.lit(False)) if "citations" in cases.columns else F.lit(False)
    return scored.withColumn("has_citation", cited).drop("_a", "_e", "_c")


def case_verdict(similarity: Column, fallback: Column, threshold: float = 0.4) -> Column:
    return F.when((similarity >= threshold) & ~fallback, "pass").otherwise("review")


def heuristic_metrics(samples: DataFrame, by: str, contexts: str | None = None) -> DataFrame:
    """Means of case_scores() over the samples in which both token sets have words. contexts: an array column; precision is then the mean share of contexts
    that are not blank, over the samples that have any."""
    some = lambda a, b: (F.size(eval_tokens(F.col(a))) > 0) & (F.size(eval_tokens(F.col(b))) > 0)
    scored = case_scores(samples)
    mean = lambda x, a, b: F.bround(F.avg(F.when(some(a, b), F.col(x))), 3)
    found = [mean("grounding", "answer", "context").alias("faithfulness"), mean("similarity", "answer", "expected").alias("relevancy"), mean("recall", "expected", "context").alias("recall")]
    if contexts:
        filled = F.size(F.filter(contexts, lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""))
        found.append(F.bround(F.avg(F.when(F.size(contexts) > 0, filled / F.size(contexts))), 3).alias("precision"))
    return scored.groupBy(by).agg(*found)


def target_grade(value: Column, target: Column) -> Column:
    return F.when(value.isNull(), "N/A").when(value >= target, "pass").when(value >= 0.85 * target, "near").otherwise("fail")


def merge_metrics(base: DataFrame, override: DataFrame, key: str) -> DataFrame:
    """base with the values of override where these are not null."""
    names = [c for c in base.columns if c != key]
    joined = base.alias("b").join(override.alias("o"), F.col(f"b.{key}") == F.col(f"o.{key}"), "left")
    return joined.select(F.col(f"b.{key}").alias(key), *(F.coalesce(f"o.{c}", f"b.{c}").alias(c) if c in override.columns else F.col(f"b.{c}") for c in names))


def eval_samples(cases: DataFrame, contexts: list[Column]) -> DataFrame:
    """cases with contexts, blank and null ones left out."""
    return cases.withColumn("contexts", F.filter(F.array(*contexts), lambda x: F.trim(x) != ""))


def ablation(question: str, score: str, **runs: DataFrame) -> DataFrame:
    """method, questions, hits, mean_best: how many questions a method answers, with how many hits, and the mean of their best scores."""
    named = [df.select(question, F.col(score).alias("_s"), F.lit(name).alias("method")) for name, df in runs.items()]
    best = reduce(lambda a, b: a.unionByName(b), named).groupBy("method", question).agg(F.count("*").alias("_n"), F.max("_s").alias("_s"))
    return best.groupBy("method").agg(F.count("*").alias("questions"), F.sum("_n").alias("hits"), F.round(F.avg("_s"), 6).alias("mean_best"))


def overview(runs: DataFrame, order: str, metrics: list[str], n: int = 6, **data: DataFrame) -> DataFrame:
    """section, name, place, value, diff. Section metric: the metrics of the last n runs in hundredths, each with the difference to the run before;
    place is the run. Section data: the sums of data's tables of one row, by column. Runs are few rows."""
    last = runs.orderBy(F.desc(order)).limit(n)
    long_ = last.select(F.col(order).cast("long").alias("place"), F.explode(F.array(*(F.struct(F.lit(m).alias("name"), F.col(m).cast("double").alias("v")) for m in metrics))).alias("m"))
    step = F.col("m.v") - F.lag("m.v").over(Window.partitionBy("m.name").orderBy("place"))
    series = long_.select(F.lit("metric").alias("section"), "m.name", "place", F.bround(F.col("m.v") * 100, 1).alias("value"), F.bround(step * 100, 1).alias("diff"))
    counts = [df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in df.columns))).alias("m")) for df in data.values()]
    rows = [c.select(F.lit("data").alias("section"), "m.name", F.lit(None).cast("long").alias("place"), F.col("m.v").alias("value"), F.lit(None).cast("double").alias("diff")) for c in counts]
    return reduce(lambda a, b: a.unionByName(b), [series, *rows])
