"""The pipeline: each stage's columns and rows, and its SQL where there is some."""

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from corpuslake.llm import queries
from corpuslake.llm.substring_dedup import drop_repeats


def test_stages(spark, docs, sf_dir):
    n = docs.count()
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, sf_dir).cache()
        assert out.columns == docs.columns
        if name != "mixing sources":
            assert out.count() <= n
        n, now = out.count(), out
    pieces = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir)
    assert pieces.select("doc_id").distinct().count() == now.select("doc_id").distinct().count()


def test_stages_keep_clashing_columns(spark, docs, sf_dir):
    """Columns named like those that the stages make for themselves stay as they are."""
    names = ["rejected", "row", "log_ratio", "n_grams", "text_", "sha_", "sha__", "id_", "own_", "kept_", "rows_", "dropped", "dropped_", "size_", "taken_", "turn_", "part_", "raw_", "spans_", "cut_"]
    now = docs.limit(60).select("*", *(F.lit(name).alias(name) for name in names))
    for _, stage in [*corpus_pipeline.STAGES[:-1], ("cut", lambda spark, docs, sf_dir: drop_repeats(docs))]:
        now = stage(spark, now, sf_dir)
        assert now.columns == [*docs.columns, *names]
        rows = now.collect()
        assert rows and all(r[name] == name for r in rows for name in names)


def test_stages_on_nothing(spark, empty, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_oracles(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    for name, sql in queries.ORACLES.items():
        want = con.sql(sql).df()
        got = queries.QUERIES[name](spark, sf_dir).toPandas()
        columns = sorted(want.columns)
        assert columns == sorted(got.columns)
        want, got = (x[columns].sort_values("doc_id").reset_index(drop=True) for x in (want, got))
        assert (want == got).all().all(), name
