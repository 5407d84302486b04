"""Exact dedup, shingle join, substring dedup and embedding join against brute force."""

import collections
import hashlib
import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslake.llm import components, embedding_join, exact_dedup, ngram_join, substring_dedup
from corpuslake.llm.common import written

from .conftest import lower, smallest, words


@pytest.mark.parametrize(("keep", "choose"), [("smallest", min), ("largest", max)])
@pytest.mark.parametrize("memtable", [1 << 26, 2000])
def test_exact_groups(docs, rows, keep, choose, memtable):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    expected = sorted(((i, k, len(g), i == k, hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows for g in [groups[lower(t)]] for k in [choose([x for x in g if x is not None], default=None)]), key=str)
    got = sorted(map(tuple, exact_dedup.exact_duplicates(docs, keep, memtable).collect()), key=str)
    assert got == expected


def test_exact_stage_keeps_one_row(docs, rows):
    left = exact_dedup.drop_exact_duplicates(docs, "largest")
    assert left.columns == docs.columns
    texts = [lower(r.text or "") for r in left.select("text").collect()]
    assert sorted(texts) == sorted({lower(t) for _, t in rows})


def test_by_bytes_agrees(docs):
    source = exact_dedup.id_and_text(docs)
    assert sorted(exact_dedup._by_bytes(source, "largest").collect(), key=str) == sorted(exact_dedup.exact_duplicates(docs, "largest").collect(), key=str)


def shingles(text, n=5):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_groups(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    lists, both = collections.defaultdict(list), collections.Counter()
    for i, s in sets.items():
        for x in s:
            lists[x].append(i)
    for members in lists.values():
        both.update(itertools.combinations(sorted(members), 2))
    return sets, smallest(sets, [(a, b) for (a, b), c in both.items() if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c)])


def test_ngram_join(docs, rows):
    sets, component = brute_groups(rows)
    for r in ngram_join.near_duplicate_groups(docs).collect():
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), component[r.doc_id])


def test_ngram_join_of_variants(spark, monkeypatch):
    """A large group of near copies of which many pairs are below the bound, with frequent shingles, small lists and few star rounds."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(150):
        w = list(base)
        for j in rng.integers(0, 120, rng.integers(0, 7)):
            w[j] = f"x{i}_{j}"
        texts.append((i, " ".join(w)))
    texts += [(1000 + i, " ".join(f"{p}{i}_{j}" for j in range(30)) + " " + " ".join(base[:20])) for p in "ab" for i in range(40) for p in [p + str(i)]]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    _, component = brute_groups(texts)
    for rounds, wide in ((0, 256), (2, 0)):
        monkeypatch.setattr(ngram_join, "STAR_ROUNDS", rounds)
        monkeypatch.setattr(ngram_join, "WIDE", wide)
        got = {r.doc_id: r.component_id for r in ngram_join.near_duplicate_groups(df).collect()}
        assert got == component


def signed_lists(spark, lists, n=10):
    keys = sorted({k for m in lists.values() for k in m})
    rows = [(k, n, [0] * ngram_join.BIT_WORDS, [s for s in lists if k in lists[s]], [n for s in lists if k in lists[s]]) for k in keys]
    return spark.createDataFrame(rows, "key long, n long, bits array<long>, sigs array<long>, rest array<long>")


def open_pairs(spark, lists, found=()):
    signed = signed_lists(spark, lists)
    open_, _ = ngram_join._still_open(signed, spark.createDataFrame(list(found), "node long, component long"))
    return {tuple(sorted((r.a, r.b))) for r in ngram_join._all_pairs(open_, signed, 75).collect()}


def test_later_rounds_see_whole_lists(spark):
    """{2, 4} stand in both lists, but all pairs of the larger one are compared, and those of components that are joined are not."""
    assert open_pairs(spark, {1: [2, 4, 3], 2: [2, 4, 3, 5]}) == set(itertools.combinations([2, 3, 4, 5], 2))
    assert open_pairs(spark, {1: [1, 2, 3, 4, 5], 2: [2, 3]}, [(2, 1), (3, 1), (4, 4), (5, 4)]) == {(a, b) for a in (1, 2, 3) for b in (4, 5)}
    assert open_pairs(spark, {1: [1, 2, 3]}, [(1, 1), (2, 1), (3, 1)]) == set()


def test_signatures_that_hash_alike_drop_no_pair(spark):
    """Sets 1 and 2 share one list only, and each stands in one of two lists whose names hash to the same smaller value."""
    named = spark.range(400000).select(F.xxhash64("id").alias("id"))
    alike = named.groupBy(F.hash("id").alias("h")).agg(F.collect_list("id").alias("ids")).where("size(ids) > 1").orderBy("h").first()
    shared = spark.range(1000000, 1001000).where(F.hash("id") > alike.h).first().id
    assert open_pairs(spark, {shared: [1, 2], alike.ids[0]: [1, 3], alike.ids[1]: [2, 4]}) == {(1, 2), (1, 3), (2, 4)}


def test_signatures_of_similar_sets_meet():
    """Two similar sets share a signature behind whose place enough is left of both."""
    rng = np.random.default_rng(5)
    universe = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    heavy, count = np.sort(universe[:1500]), dict(zip(universe.tolist(), rng.integers(1, 30, 4000).tolist(), strict=True))
    frequent = heavy, rng.permutation(len(heavy))
    tried = 0
    for _ in range(600):
        n = int(rng.integers(3, 300))
        pool = heavy if rng.random() < 0.5 else universe
        a = np.unique(rng.choice(pool, n, replace=False))
        drop = int(rng.integers(0, ngram_join.errors(len(a)) + 1))
        keep = rng.permutation(a)[drop:]
        add = int(len(keep) / 0.75 - len(a))
        b = np.unique(np.concatenate([keep, rng.choice(universe, max(0, add), replace=False)]))
        both = np.intersect1d(a, b)
        if 100 * len(both) < 75 * (len(a) + len(b) - len(both)):
            continue
        tried += 1
        found = []
        for x in (a, b):
            rank = ngram_join.ranks(x, frequent)
            common, rare = x[rank >= 0][np.argsort(rank[rank >= 0])], x[rank < 0]
            shared = np.array([t for t in rare.tolist() if count[t] > 1 or t in set(both.tolist())], np.uint64)
            shared = shared[np.lexsort((shared, [count[t] for t in shared.tolist()]))]
            sig, rest = ngram_join.signatures(len(x), len(x) - len(common) - len(shared), shared, common)
            found.append(dict(zip(sig.tolist(), rest.tolist(), strict=True)))
        x, y = found
        assert any(min(x[s], y[s]) * 175 >= 75 * (len(a) + len(b)) for s in x.keys() & y.keys())
        apart = np.unpackbits((ngram_join.parities(a) ^ ngram_join.parities(b)).view(np.uint8)).sum()
        assert apart <= len(np.setxor1d(a, b))
    assert tried > 200


def test_random_groups(spark, monkeypatch):
    """Groups of copies with many and few edits, sets within sets, tiny texts and passages, with a low bound for what is frequent."""
    rng = np.random.default_rng(11)
    passage = [f"p{i}" for i in range(40)]
    texts = [(i, " ".join(f"t{x}" for x in rng.integers(0, 3, rng.integers(1, 9)))) for i in range(60)]
    for g in range(25):
        base = [f"g{g}_{i}" for i in range(int(rng.integers(6, 90)))]
        for k in range(int(rng.integers(2, 12))):
            w = list(base)
            for j in rng.integers(0, len(w), rng.integers(0, 4)):
                w[j] = f"x{g}_{k}_{j}"
            w = w[int(rng.integers(0, 3)) :] + (passage if rng.random() < 0.3 else [])
            texts.append((1000 + 50 * g + k, " ".join(w)))
    texts += [(5000 + i, " ".join(passage + [f"y{i}_{j}" for j in range(8)])) for i in range(50)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    _, component = brute_groups(texts)
    assert len(set(component.values())) < len(texts) - 40
    for bound in (32, 2):
        monkeypatch.setattr(ngram_join, "FREQUENT", bound)
        got = {r.doc_id: r.component_id for r in ngram_join.near_duplicate_groups(df).collect()}
        assert got == component


def test_near_stage(docs):
    left = ngram_join.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert 9006 in ids and 9007 not in ids and None in ids


def test_components(spark):
    rng = np.random.default_rng(1)
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    some = [(int(a), int(b)) for a, b in rng.integers(2000, 2300, (200, 2))]
    edges = [*chain, *star, *some, (5, 5), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    real = [(a, b) for a, b in edges if a is not None and a != b]
    expected = smallest({x for e in real for x in e}, real)
    assert {r.node: r.component for r in components.connected_components(df).collect()} == expected
    assert components.connected_components(df.limit(0)).count() == 0


def test_substring_passages(docs, rows):
    n = 50
    seen = collections.defaultdict(set)
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - n + 1):
            seen[tuple(w[j : j + n])].add(i)
    expected = {i for s in seen.values() if len(s - {None}) > 1 for i in s if i is not None}
    got = substring_dedup.repeated_passages(docs).collect()
    assert {r.doc_id for r in got} == expected
    texts = {i: t.encode() for i, t in rows}
    for r in got:
        assert 0 <= r.start < r.end <= len(texts[r.doc_id]) and r.first_doc_id <= r.doc_id


def test_chunks_resist_shifts():
    rng = np.random.default_rng(2)
    text = bytes(rng.integers(97, 123, 5000).astype(np.uint8))
    moved = text[:1000] + b"an insertion" + text[1000:]
    cut = lambda t: set(substring_dedup.chunks(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[3].tolist())
    a, b = cut(text), cut(moved)
    assert len(a - b) <= 12 and len(a) > 80
    ends = substring_dedup.chunks(np.frombuffer(text, np.uint8), np.array([0, 2000, 5000]))
    assert ends[1][0] == 0 and (ends[2][:-1] == ends[1][1:]).all() and ends[2][-1] == 5000 and 2000 in ends[1]


def test_repeats_are_cut(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, 6))
    passage, rest = " ".join(word() for _ in range(80)), [" ".join(word() for _ in range(40)) for _ in range(3)]
    df = spark.createDataFrame([(1, f"{rest[0]} {passage} é"), (2, f"é {passage} {rest[1]}"), (3, rest[2])], "doc_id long, text string")
    got = {r.doc_id: r.text for r in substring_dedup.drop_repeats(df).collect()}
    assert got[1] == f"{rest[0]} {passage} é" and got[3] == rest[2]
    assert got[2].startswith("é") and got[2].endswith(rest[1]) and len(got[2]) < len(rest[1]) + 200


def test_a_shared_chunk_keeps_the_passage(spark):
    """Documents 10 and 20 share a passage, 3 holds 15 words of it only, and 30 is made of the words of two others: neither is a passage's first."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, 6))
    make = lambda n: [word() for _ in range(n)]
    passage, p, q = make(120), make(40), make(40)
    texts = {3: make(30) + passage[50:65] + make(30), 10: make(30) + passage + make(30), 20: make(30) + passage + make(30), 31: p + make(9), 32: q + make(9), 30: p + q}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    got = {(r.doc_id, r.first_doc_id, r.words) for r in substring_dedup.repeated_passages(df).collect()}
    assert got == {(10, 10, 120), (20, 10, 120)}
    left = {r.doc_id: r.text for r in substring_dedup.drop_repeats(df).collect()}
    assert {i for i in texts if left[i] != " ".join(texts[i])} == {20} and not set(passage) & set(left[20].split())


def vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((60, 12))
    near = base[:20] + rng.standard_normal((20, 12)) * 0.1
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, near]))]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, None), (103, [0.0] * 12), (104, [float("nan")] * 12), (105, [None, *[1.0] * 11]), (106, []), (None, rows[3][1]), (107, [x * 1e-30 for x in rows[5][1]]), (108, rows[7][1][:6])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rows


@pytest.mark.parametrize(("block", "leaf"), [(4096, 256), (16, 4)])
def test_embedding_join(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(embedding_join, "BLOCK", block)
    monkeypatch.setattr(embedding_join, "LEAF", leaf)
    df, rows = vectors(spark)
    unit = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.zeros(12)
            x[: len(v)] = v
            x /= np.abs(x).max()
            unit[i] = x / np.linalg.norm(x)
    links = [(a, b) for a, b in itertools.combinations(unit, 2) if unit[a] @ unit[b] >= 0.95]
    degree = collections.Counter(x for link in links for x in link)
    component = smallest({i for i, _ in rows if i is not None}, links)
    got = embedding_join.near_duplicate_vectors(df.repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.vec_id is None:
            assert (r.n_links, r.component_id) == (0, None)
        else:
            assert (r.n_links, r.component_id, r.kept) == (degree[r.vec_id], component[r.vec_id], component[r.vec_id] == r.vec_id), r


def test_blocks_meet_without_a_shuffle(spark):
    """Each pair of near blocks is there once with what both hold, and no block is shuffled or broadcast for it, so the disk grows with the rows and not with their pairs."""
    rows = [(0, b, [float(b), 0.0], [b + 0.5, 1.0], bytes([b]), b"c", b"l", b"d" * 1000) for b in range(40)]
    schema = "part long, block long, low array<double>, high array<double>, nodes binary, copies binary, lead binary, data binary"
    blocks = written(spark.createDataFrame(rows, schema).repartition(9), "blocks")
    pairs = embedding_join.near_block_pairs(blocks, 0.6, 4)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CartesianProduct" in plan
    got = sorted((r.x_block, r.y_block, bytes(r.x_nodes), bytes(r.y_nodes)) for r in pairs.collect())
    assert got == [(x, y, bytes([x]), bytes([y])) for x in range(40) for y in range(x, 40) if y - x <= 1]


@pytest.mark.parametrize("spread", [0.02, 0.12, 1.0])
def test_intervals_join_exactly(monkeypatch, spread):
    """Crowded, mixed and scattered vectors, in leaves and columns that do not divide their number."""
    for name, value in (("LEAF", 7), ("COLUMNS", 10), ("FACTOR_BYTES", 800)):
        monkeypatch.setattr(embedding_join, name, value)
    rng = np.random.default_rng(4)
    a, b = (rng.standard_normal(10) + spread * rng.standard_normal((n, 10)) for n in (45, 33))
    b[:20] = a[:20] + spread * rng.standard_normal((20, 10)) / 4
    a, b = (x / np.linalg.norm(x, axis=1)[:, None] for x in (a, b))
    for c, same in ((b, False), (a, True)):
        got = [pair for i, j in embedding_join.join_intervals(a, c, a[:, :4], c[:, :4], same, 0.95) for pair in zip(i.tolist(), j.tolist(), strict=True)]
        want = [(i, j) for i, j in np.argwhere(a @ c.T >= 0.95).tolist() if not same or i < j]
        assert sorted(got) == want


def test_one_id_of_several_vectors(spark):
    """Each row has the links of its own vector; component_id is the smallest id that any vector of the component has."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_join.near_duplicate_vectors(df).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)]


def test_pairs_at_the_bound_do_not_depend_on_order(spark):
    """Many pairs within rounding of the bound."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(60):
        u, v = np.linalg.qr(rng.standard_normal((12, 2)))[0].T
        rows += [(2 * i, u.tolist()), (2 * i + 1, (0.95 * u + np.sqrt(1 - 0.95**2) * v).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    first, again = (sorted(embedding_join.near_duplicate_vectors(d).collect()) for d in (df, df.orderBy(F.desc("vec_id")).repartition(5)))
    assert first == again


def test_empty(spark, empty):
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert exact_dedup.drop_exact_duplicates(empty).count() == 0
    assert ngram_join.near_duplicate_groups(empty).count() == 0
    assert substring_dedup.repeated_passages(empty).count() == 0
    assert embedding_join.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert embedding_join.near_duplicate_vectors(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect()[0].n_links == 0


def test_no_passage_is_lost(spark):
    """50 words shared by two documents each, in any text: short words, one word again and again, columns of digits, very long words, other white space."""
    rng = np.random.default_rng(12)
    pick = lambda xs, n: [xs[i] for i in rng.integers(0, len(xs), n)]
    letters = [chr(97 + i) for i in range(26)]
    kinds = {
        "short": letters[:9] + [a + b for a in letters[:4] for b in letters[:3]],
        "two": [a + b for a in letters[:6] for b in letters[:6]],
        "digits": ["0", "1", "10", "0.5", "|"],
        "usual": ["".join(pick(letters, n)) for n in rng.integers(3, 9, 400)],
        "long": ["".join(pick(letters, 150)) for _ in range(30)],
        "pairs": ["ab", "ab", "ab", "cd"],
    }
    texts, expected = {}, set()
    for kind, vocabulary in kinds.items():
        for trial in range(20):
            passage = pick(vocabulary, 50) if trial % 5 else (pick(vocabulary, 1) * 50 if trial % 2 else (pick(vocabulary, 3) * 17)[:50])
            for side in (0, 1):
                around = [pick(kinds["usual"], int(rng.integers(0, 60))) for _ in range(2)]
                own = f"q{kind}{trial}{side}"  # so that no more than the passage is shared
                gaps = pick([" ", "\n", "  ", "\t"] if trial % 3 == 0 else [" "], 500)
                all_ = [*around[0], own, *passage, own + "x", *around[1]]
                i = len(texts)
                texts[i] = "".join(w + g for w, g in zip(all_, gaps, strict=False))
                expected.add(i)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id for r in substring_dedup.repeated_passages(df).collect()}
    assert got == expected
    for words_ in (8, 20):
        seen = collections.defaultdict(set)
        for i, t in texts.items():
            w = words(t)
            for j in range(len(w) - words_ + 1):
                seen[tuple(w[j : j + words_])].add(i)
        want = {i for s in seen.values() if len(s) > 1 for i in s}
        assert {r.doc_id for r in substring_dedup.repeated_passages(df, words_).collect()} == want


def test_vectors_of_many_lengths(spark):
    """Wide vectors among short ones: each is held at its own length, and a shorter one counts as padded with zeros."""
    rng = np.random.default_rng(14)
    base = [rng.standard_normal(8) for _ in range(50)]
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    wide = rng.standard_normal(6000)
    rows += [(100, wide.tolist()), (101, (wide + 0.01 * rng.standard_normal(6000)).tolist()), (102, [*(3 * base[7]).tolist(), *([0.0] * 1492)]), (103, [*base[8].tolist(), 0.001]), (104, [0.0] * 2999 + [1.0]), (105, [0.0] * 2999 + [2.0, 0.1])]
    rows += [(200 + n, [*base[9].tolist(), *([0.0] * n)]) for n in range(1, 20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    longest = max(len(v) for _, v in rows)
    x = np.array([np.pad(v, (0, longest - len(v))) for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.95) & ~np.eye(len(rows), dtype=bool)
    ids = [i for i, _ in rows]
    want = smallest(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(near), strict=True)])
    begun = time.time()
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_join.near_duplicate_vectors(df).collect()}
    assert got == {i: (int(near[k].sum()), want[i]) for k, i in enumerate(ids)} and got[100][0] == 1
    assert time.time() - begun < 90
