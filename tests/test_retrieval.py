"""Vector and lexical search against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslake.functions import rules
from corpuslake.operators import lexical, retrieval, scorers, vectors


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, v array<double>, grp string")


def plain_topk(asked, held, k, threshold, scope=None):
    out = set()
    for q, v, *s in asked:
        if not v or not all(x is not None and math.isfinite(x) for x in v) or not any(v):
            continue
        found = []
        for i, w, g in held:
            if not w or len(w) != len(v) or not all(x is not None and math.isfinite(x) for x in w) or not any(w) or (s and s[0] is not None and g not in s[0]):
                continue
            a, b = (np.array(x, float) / max(map(abs, x)) for x in (v, w))
            score = math.floor(float(a @ b) / math.sqrt(float(a @ a) * float(b @ b)) * 1e6 + 0.5) / 1e6
            if score >= threshold:
                found.append((-score, i))
        out |= {(q, i, -s_, rank + 1) for rank, (s_, i) in enumerate(sorted(found)[:k])}
    return out


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(4)
    held = [(i, [pick.gauss(0, 1) for _ in range(8)], pick.choice(["a", "b", None])) for i in range(300)]
    held += [(300 + i, held[i][1], "b") for i in range(20)]  # ties
    held += [(400, None, "a"), (401, [], "a"), (402, [0.0] * 8, "a"), (403, [float("nan")] * 8, "a"), (404, [None] * 8, "a"), (405, [1.0, 2.0], "a"), (406, [float("inf")] * 8, "a"), (407, [1e200] * 8, "a")]
    return held


@pytest.mark.parametrize("passes", [8192, 3])
def test_dense_topk(spark, rows, passes, monkeypatch):
    monkeypatch.setattr(vectors, "PASS_QUESTIONS", passes)
    monkeypatch.setattr(vectors, "BLOCK_SCORES", 64)
    asked = [(i, v, [None, ["a"], ["a", "b"], []][i % 4]) for i, v, _ in rows if i < 12 or i >= 400]
    questions = spark.createDataFrame(asked, "q long, v array<double>, scope array<string>")
    held = table(spark, rows)
    got = {tuple(r) for r in vectors.dense_topk(questions, held, "q", "id", "v", 5, 0.2).select("q", "id", "score", "rank").collect()}
    assert got == plain_topk([r[:2] for r in asked], rows, 5, 0.2) and got
    got = {tuple(r) for r in vectors.dense_topk(questions, held, "q", "id", "v", 5, 0.2, "scope", "grp").select("q", "id", "score", "rank").collect()}
    assert got == plain_topk(asked, rows, 5, 0.2, True)
    every = {tuple(r)[:3] for r in vectors.dense_hits(questions, held, "q", "id", "v", 0.2).select("q", "id", "score").collect()}
    assert every == {r[:3] for r in plain_topk([r[:2] for r in asked], rows, 10**6, 0.2)}
    assert vectors.dense_topk(questions, held.limit(0), "q", "id", "v").collect() == [] == vectors.dense_topk(questions.limit(0), held, "q", "id", "v").collect()


def test_plan_has_no_pairs(spark, rows):
    held = vectors.payload_filter(table(spark, rows).withColumn("status", F.lit("x")), "status", grp=["a", "b"])
    plan = vectors.dense_topk(held.withColumnRenamed("id", "q"), held, "q", "id", "v")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_payload_filter(spark):
    df = spark.createDataFrame([(1, "a", "active"), (2, "b", "repealed"), (3, "a", None), (4, None, "superseded"), (5, "c", "Hết hiệu lực")], "id long, p string, s string")
    ids = lambda x: sorted(r.id for r in x.collect())
    assert ids(vectors.payload_filter(df, "s")) == [1, 3]
    assert ids(vectors.payload_filter(df, None, p="a")) == [1, 3] and ids(vectors.payload_filter(df, "s", p=["b", "c"])) == [] and ids(vectors.payload_filter(df, p=None)) == [1, 2, 3, 4, 5]


def recall(got, want, k):
    wanted = {r[:2] for r in want if r[3] <= k}
    return len(wanted & {r[:2] for r in got if r[3] <= k}) / len(wanted)


def searched(spark, questions, held, k, threshold, **more):
    files = vectors.write_vector_index(held, "id", "v", "grp", cells=more.pop("cells", None))
    got = {tuple(r) for r in vectors.dense_topk_index(spark, questions, files, held, "q", "id", "v", k, threshold, **more).select("q", "id", "score", "rank").collect()}
    share = vectors.pairs_looked_at(spark, questions, files, "q", "v", threshold, more.get("probes"))
    vectors.drop_vector_index(spark, files)
    return got, share


@pytest.mark.parametrize("k", [6, 18])
def test_vector_index(spark, rows, k):
    """Random directions: no cell can be left out, and the result is that of the exact search. Groups of directions: a twentieth of the cells is enough."""
    questions = spark.createDataFrame([(i, v, ["a"] if i % 3 else None) for i, v, _ in rows if i < 30], "q long, v array<double>, scope array<string>")
    held = table(spark, rows)
    want = {tuple(r) for r in vectors.dense_topk(questions, held, "q", "id", "v", k, 0.2, "scope", "grp").select("q", "id", "score", "rank").collect()}
    got, _ = searched(spark, questions, held, k, 0.2, scope="scope")
    assert recall(got, want, k) >= 0.99 and {r[2] for r in got} - {r[2] for r in want} == set()
    pick = np.random.default_rng(3)
    centres = pick.normal(size=(40, 24))
    data = [(int(i), (centres[i % 40] + 0.35 * pick.normal(size=24)).tolist(), "a") for i in range(3000)] + [(4000, [1.0, 0.0], "a"), (4001, None, "a")]
    held = table(spark, data)
    questions = held.where("id % 50 = 0").select(F.col("id").alias("q"), "v")
    want = {tuple(r) for r in vectors.dense_topk(questions, held, "q", "id", "v", k, 0.3).select("q", "id", "score", "rank").collect()}
    got, share = searched(spark, questions, held, k, 0.3, probes=0.05)
    assert recall(got, want, k) >= 0.9 and share < 0.1
    whole, pruned = searched(spark, questions, held, k, 0.9)
    assert recall(whole, {r for r in want if r[2] >= 0.9}, k) >= 0.99 and pruned < 0.6


TEXTS = [(1, "a", "alpha beta beta gamma"), (2, "a", "beta delta"), (3, "b", "alpha alpha epsilon"), (4, "b", "zeta eta theta delta"), (5, None, ""), (6, None, None), (7, "c", "alpha beta"), (8, "c", "beta beta beta beta"), (9, "d", "alpha word")]


def plain_bm25(rows, question, scope):
    docs = [(i, scorers.words_of(t or "")) for i, g, t in rows if scope is None or (g or "") in scope]
    docs = [(i, w) for i, w in docs if w]
    n, mean_length = len(docs), sum(len(w) for _, w in docs) / max(1, len(docs))
    df = {t: sum(t in w for _, w in docs) for _, ws in docs for t in ws}
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    mean = sum(raw.values()) / max(1, len(raw))
    out = {}
    asked = scorers.words_of(question)
    for i, w in docs:
        s = sum((raw[t] if raw[t] >= 0 else 0.25 * mean) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / mean_length)) for t in asked if t in w)
        if round(s, 6) > 0:
            out[i] = round(s, 6)
    if not out:
        out = {i: round(len(set(asked) & set(w)) / len(set(asked)), 6) for i, w in docs if set(asked) & set(w)}
    return out


def test_lexical_index(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PART_POSTINGS", 2)
    docs = spark.createDataFrame(TEXTS, "id long, grp string, text string")
    asked = [(1, "alpha beta beta", None), (2, "alpha zeta", ["b"]), (3, "delta gamma", ["a", "b"]), (4, "alpha word", ["d"]), (5, "nothing here", None), (6, "", None), (7, "beta", ["c", "a"]), (8, "alpha", [])]
    questions = spark.createDataFrame(asked, "q long, text string, scope array<string>")
    index = lexical.write_lexical_index(docs, "id", ["text"], "grp", buckets=3)

    def found(index):
        out = {}
        for r in lexical.lexical_hits(questions, index, "q", "text", "scope").collect():
            out.setdefault(r.q, {})[r.id] = pytest.approx(r.score, abs=2e-6)
        return out

    plain = lambda rows: {q: s for q, t, scope in asked if t and (s := plain_bm25(rows, t, scope))}
    assert found(index) == plain(TEXTS)
    changed = [(2, "a", "gamma gamma"), (10, "b", "alpha delta")]
    new = lexical.reindexed(spark, index, spark.createDataFrame([(2,), (3,)], "id long"), spark.createDataFrame(changed, "id long, grp string, text string"), ["text"], "grp")
    assert found(new) == plain([r for r in TEXTS if r[0] not in (2, 3)] + changed)
    # another session opens the tables by their folder
    spark.sql(f"drop table {new.name}_postings")
    assert found(new) == plain([r for r in TEXTS if r[0] not in (2, 3)] + changed)
    for x in (index, new):
        lexical.drop_index(spark, x)
    nothing = lexical.write_lexical_index(docs.limit(0), "id", ["text"], buckets=2)
    assert lexical.lexical_hits(questions, nothing, "q", "text", "scope").collect() == []


def test_many_groups_are_counted_where_asked(spark, monkeypatch):
    """Beyond GROUPS groups the index keeps no terms of each, so that it stays smaller than its postings; searches find the same."""
    monkeypatch.setattr(lexical, "GROUPS", 2)
    docs = spark.createDataFrame(TEXTS, "id long, grp string, text string")
    asked = [(1, "alpha beta beta", None), (2, "alpha zeta", ["b"]), (3, "delta gamma", ["a", "b"]), (4, "alpha word", ["d"]), (5, "nothing here", None), (6, "", None), (7, "beta", ["c", "a"]), (8, "alpha", []), (9, "beta alpha beta", ["c"]), (10, "alpha", ["none"])]
    questions = spark.createDataFrame(asked, "q long, text string, scope array<string>")
    index = lexical.write_lexical_index(docs, "id", ["text"], "grp", buckets=3)
    assert {r.grp for r in index.terms(spark).collect()} == {lexical.ALL}
    changed = [(2, "a", "gamma gamma"), (10, "b", "alpha delta")]
    new = lexical.reindexed(spark, index, spark.createDataFrame([(2,), (3,)], "id long"), spark.createDataFrame(changed, "id long, grp string, text string"), ["text"], "grp")
    for made, rows in ((index, TEXTS), (new, [r for r in TEXTS if r[0] not in (2, 3)] + changed)):
        got = {}
        for r in lexical.lexical_hits(questions, made, "q", "text", "scope").collect():
            got.setdefault(r.q, {})[r.id] = pytest.approx(r.score, abs=2e-6)
        assert got == {q: s for q, t, scope in asked if t and (s := plain_bm25(rows, t, scope))}
        lexical.drop_index(spark, made)


def test_kept_index_is_not_shuffled(spark):
    docs = spark.createDataFrame(TEXTS, "id long, grp string, text string")
    index = lexical.write_lexical_index(docs, "id", ["text"], "grp", buckets=3)
    plan = index.terms(spark).groupBy("term", "grp").agg(F.sum("df"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
    lexical.drop_index(spark, index)


def test_rerank(spark):
    hits = spark.createDataFrame([(1, 1, 0.9, 2.0), (1, 2, 0.5, 4.0), (1, 3, 0.7, 3.0), (2, 1, 0.4, 1.0), (2, 2, 0.6, 1.0), (3, 1, 0.1, None), (3, 2, 0.2, 5.0)], "q long, id long, score double, ce double")
    got = {(r.q, r.id): (round(r.score, 6), r.rank) for r in scorers.rerank(hits, "q", "id", 2, "ce").collect()}
    assert got == {(1, 2): (0.9, 1), (1, 3): (0.54, 2), (2, 2): (0.92, 1), (2, 1): (0.88, 2), (3, 2): (0.2, 1), (3, 1): (0.1, 2)}
    assert [r.id for r in scorers.rerank(hits.where("q = 1"), "q", "id", 3).orderBy("rank").collect()] == [1, 3, 2]


def test_plugged_in_models(spark):
    df = spark.createDataFrame([(1, "alpha beta", "alpha gamma"), (2, None, "x"), (3, "beta", None)], "id long, q string, t string")
    assert [r.ce_score for r in scorers.score_pairs(df, "q", "t").orderBy("id").collect()] == [0.5, 0.0, 0.0]
    coded = scorers.encode(df, "q", scorers.hashed_words, dims=16).orderBy("id").collect()
    assert [len(r.embedding) for r in coded] == [16] * 3 and sum(coded[1].embedding) == 0
    assert coded[0].embedding == pytest.approx(scorers.hashed_words(16)(["alpha beta"])[0].tolist())
    assert set(retrieval.FUSIONS) == {"rrf", "weighted"}


def test_postings_stay_with_their_chunk(spark, tmp_path):
    """The tasks that tokenise write the segments: the postings of a chunk stand side by side, with its stop words left out and one head."""
    docs = spark.createDataFrame([(i, "b a c b".replace("a", "alpha").replace("b", "beta").replace("c", "của") + f" word{i % 3}") for i in range(40)], "id long, text string").coalesce(1)
    index = lexical.write_lexical_index(docs, "id", ["text"], folder=str(tmp_path / "index"), buckets=3)
    rows = index.postings(spark).coalesce(1).collect()
    keys = [r.key for r in rows]
    assert keys == sorted(keys) and sum(r.head for r in rows) == 40
    of = {r.term: r.tf for r in rows if r.key == 4}
    assert of == {"alpha": 1, "beta": 2, "word1": 1} | ({"của": 1} if "của" not in rules.STOP_WORDS else {}) and all(r.dl == sum(of.values()) for r in rows if r.key == 4)
    lexical.drop_index(spark, index)
