"""Packing, mixing, quality, language, licence and secret operators against plain versions."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpuslake.llm import language_id, license_scan, mixing, packing, quality, secret_scan

from .conftest import lower, words

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_packing_round_trip(docs, rows):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    pieces = packing.pack_documents(docs, PATH).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for i, group in by_doc.items():
        expected = collections.Counter()
        for j, t in rows:
            if j == i:
                ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
                for s in range(0, len(ids), 2048):
                    expected[s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)] += 1
        assert collections.Counter((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in group) == expected
    assert set(by_doc) == {i for i, _ in rows}
    for group in by_sequence.values():
        at = 0
        for p in sorted(group, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    total = sum(p.length for p in pieces)
    assert len(by_sequence) <= total / 2048 * 1.02 + 2


def test_word_tokenizer_is_the_tokenizer():
    whole = Tokenizer.from_file(PATH)
    whole.encode_special_tokens = True
    mine = packing.WordTokenizer(PATH)
    for t in ["", " ", "don't 'tis it's we'll", "a.b,c!! x*** (y) -z- 3.14 a1b2", "ÀÉ é ß ǅ Ω ΑΣ ΑΣ. İ K ſ", "é H̱", "a b c\x1cd\x85e", "<|endoftext|> x<|startoftext|>", "“quoted” – dash…", "ab‍cd ﬁ ½ ²", "日本語 テキスト", "_under_score_ `tick` ~", "é,è;ç.", "1,000.00 50% a+b=c"]:
        assert np.frombuffer(mine.ids(t.encode()), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_column_generation_reaches_the_bound():
    sizes, counts = np.array([3, 5, 7, 10]), np.array([97, 61, 36, 21])
    plan = packing.whole_patterns(sizes, counts, 10)
    held = sum(n * items for n, items in plan)
    assert (held >= counts).all() and all(items @ sizes <= 10 for _, items in plan)
    fractional = sum(x for _, x in packing.column_generation(sizes, counts, 10, gap=0))
    assert fractional <= sum(n for n, _ in plan) <= fractional + len(sizes) + 1
    value, pattern = packing.best_pattern(np.array([3.1, 5.0, 7.3, 10.2]), sizes, 10)
    assert value == pytest.approx(10.4) and pattern.tolist() == [1, 0, 1, 0]


def targets(sizes, weights=(5, 2, 1)):
    """Dealing by weight, again and again, what is above the caps."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    out, open_, left = dict.fromkeys(names, 0.0), set(names), 1.5 * sum(sizes.values())
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 2 * sizes[s]}
        for s in full or open_:
            out[s] = 2.0 * sizes[s] if full else share * weight[s]
        left -= sum(out[s] for s in full)
        open_ -= full or open_
    return out


def plain_mix(rows):
    """Words taken by (doc_id, source, size), from a queue in plain Python."""
    sizes = collections.Counter()
    count = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    for r in rows:
        sizes[r.source] += count(r)
    goal = targets(sizes)
    order = lambda r: (hashlib.md5(("mix" + ("" if r.doc_id is None else str(r.doc_id))).encode()).hexdigest(), r.doc_id is not None, r.doc_id or 0, count(r))
    queue = []
    for source in sizes:
        at = 0
        for copy in range(2):
            for i, r in enumerate(sorted((r for r in rows if r.source == source), key=order)):
                at += count(r)
                if goal[source]:
                    queue.append((at / goal[source], source is None, source or "", order(r), i, copy, r))
    left, taken = int(sum(goal.values()) + 1e-9), collections.Counter()
    for *_, r in sorted(queue, key=lambda x: x[:-1]):
        n = min(left, count(r))
        taken[r.doc_id, r.source, count(r)] += n
        left -= n
    return sizes, goal, taken


def test_mixing(docs):
    sizes, goal, expected = plain_mix(docs.select("doc_id", "text", "source").collect())
    taken, by_source = collections.Counter(), collections.Counter()
    for r in mixing.mix_documents(docs).collect():
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.doc_id, r.source, r.size] += r.taken
        by_source[r.source] += r.taken
    assert +taken == +expected
    longest = max(len(words(r.text or "")) for r in docs.select("text").collect())
    assert sum(by_source.values()) == int(sum(goal.values()) + 1e-9) and all(abs(by_source[s] - goal[s]) <= longest for s in goal)
    first, again = (sorted(mixing.mixing_query(d).collect(), key=str) for d in (docs, docs.repartition(3)))
    assert first == again


def test_mixing_buckets_and_queue(docs, monkeypatch):
    whole = sorted(mixing.mixing_query(docs).collect(), key=str)
    monkeypatch.setattr(mixing, "ROWS_A_BUCKET", 7)
    assert sorted(mixing.mixing_query(docs).collect(), key=str) == whole
    sizes = mixing.word_sizes(docs)
    served = mixing.serve(mixing.queue(sizes, mixing.source_targets(sizes).withColumnRenamed("source", "goal_source"), 2, "mix"), 1000, 3).orderBy("range", "finish").collect()
    times = [r.finish for r in served if r.finish is not None]
    assert times == sorted(times) and len({r.range for r in served}) == 3
    assert sum(r.taken for r in served) == 1000 and len(served) == 2 * docs.count()


def test_mix_stage_takes_the_words(docs, spark):
    """Also rows that share a doc_id, of two sources, and columns named like the operator's own."""
    more = spark.createDataFrame([(7, "a b c d", "x"), (7, "e f g h", "x"), (7, "a b c d", "y"), (7, "a b c d", "x"), (8, "i j", None)], "doc_id long, text string, source string")
    some = docs.unionByName(more, allowMissingColumns=True).withColumn("taken_", F.lit(1)).withColumn("part_", F.lit(2)).withColumn("__words", F.lit(3))
    _, _, taken = plain_mix(some.select("doc_id", "text", "source").collect())
    out = mixing.apply_mix(some)
    assert out.columns == some.columns
    got, expected = collections.Counter(), collections.Counter()
    for r in out.collect():
        got[r.doc_id, r.source] += len(words(r.text))
        assert (r.taken_, r.part_, r["__words"]) == (1, 2, 3)
    for (i, source, _), n in taken.items():
        expected[i, source] += n
    assert +got == +expected


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def test_quality_parts_good_from_bad(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality.quality_scores(docs, labels)
    got = scored.join(labels, "doc_id").groupBy("quality").agg({"kept": "count", "*": "count"}).collect()
    assert len(got) == 2
    rows = scored.join(labels, "doc_id").select("quality", "kept").collect()
    good, bad = [r.kept for r in rows if r.quality], [r.kept for r in rows if not r.quality]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.05
    held = scored.join(labels, "doc_id", "left_anti").count()
    assert held > 0


def test_quality_is_counted_and_ranked_plainly(docs, labels, spark):
    """Counts, ratios, noise and the k-th key, one document at a time."""
    rows = docs.select("doc_id", "text", F.expr("(pmod(xxhash64('quality', doc_id), 4503599627370496L) + 0.5) / 4503599627370496D").alias("u")).collect()
    marks = collections.defaultdict(int)
    for r in labels.collect():
        marks[r.doc_id] = max(marks[r.doc_id], r.quality)
    half = quality.BUCKETS // 2
    raw, target = [1.0] * (2 * half), [1.0] * (2 * half)
    grams = []
    for r in rows:
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        grams.append(quality.features(data, np.array([0, len(data)]))[1].tolist())
        for g in grams[-1]:
            raw[g] += 1
            target[g] += marks[r.doc_id] == 1
    sums = [(sum(x[:half]), sum(x[half:])) for x in (target, raw)]
    ratio = [math.log(target[g] / sums[0][g >= half]) - math.log(raw[g] / sums[1][g >= half]) for g in range(2 * half)]
    scores, _, level, cut = quality._decide(docs.select("doc_id", "text"), labels, quality.LABELLED, quality.BUCKETS)
    expected = [(sum(ratio[g] for g in own), len(own), r.u) for own, r in zip(grams, rows, strict=True)]
    k = sum(s >= level * n for s, n, _ in expected)
    keys = sorted((s - level * n - math.log(-math.log(u)) for s, n, u in expected), reverse=True)
    assert 0 < k < len(rows) and cut == pytest.approx(keys[k - 1], rel=1e-6, abs=1e-6)
    got = sorted((str(r.doc_id), r.n_grams, r.log_ratio, r.kept) for r in quality.quality_scores(docs, labels).collect())
    plain = sorted((str(r.doc_id), n, s, s - level * n - math.log(-math.log(u)) >= keys[k - 1] - 1e-9) for (s, n, u), r in zip(expected, rows, strict=True))
    for x, y in zip(got, plain, strict=True):
        assert x[:2] == y[:2] and x[2] == pytest.approx(y[2], rel=1e-6, abs=1e-6) and x[3] == y[3]


def test_quality_hard_rows(docs, labels, empty, spark):
    scored = quality.quality_scores(docs, labels)
    assert scored.count() == docs.count()
    assert sorted(scored.collect(), key=str) == sorted(quality.quality_scores(docs.repartition(2), labels).collect(), key=str)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == scored.where("kept").count()
    assert quality.quality_scores(empty, labels).count() == 0
    assert quality.quality_scores(docs, labels.limit(0)).count() == docs.count()


def test_top_k_cut(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.standard_normal(500) * 1e6, rng.standard_normal(500), [1.0] * 50])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    for k in (1, 2, 300, 530, 1049):
        assert quality.top_k_cut(df, "x", k, bins=16) == np.sort(values)[-k]
    assert quality.top_k_cut(df, "x", 1050) == float("-inf") and quality.top_k_cut(df, "x", 0) == float("inf")


def test_gru_gradients():
    rng = np.random.default_rng(0)
    model = language_id.LanguageModel.new(["a", "b", "c"])
    for name in ("embedding", "out", "bias"):
        setattr(model, name, getattr(model, name).astype(np.float64))
    for g in (model.forward, model.backward):
        g.w, g.u, g.b = (x.astype(np.float64) for x in (g.w, g.u, g.b))
    text, mask = language_id.padded([b"hello", b"abc", b"xy"])
    lang = np.array([0, 1, 2])
    _, grads = model.gradients(text, mask, lang)
    for p, g in zip(model.parameters(), grads, strict=True):
        for _ in range(3):
            at = tuple(rng.integers(0, n) for n in p.shape)
            if p.shape[0] == 256:
                at = (int(text[0, 1]), *at[1:])
            old = p[at]
            p[at] = old + 1e-2
            up = model.gradients(text, mask, lang)[0]
            p[at] = old - 1e-2
            down = model.gradients(text, mask, lang)[0]
            p[at] = old
            assert g[at] == pytest.approx((up - down) / 2e-2, abs=3e-3)


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs, documents=400)
    got = language_id.identify_languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    assert np.mean([r.lang == r.lang_pred for r in got if r.held_out]) >= 0.98


def plain_labels(model, text):
    """Probabilities at each byte, one text and one byte at a time; long texts in stretches as documented."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    k = language_id.HIDDEN

    def states(gru, codes):
        h, out = np.zeros(k), []
        for b in codes:
            x, hu = model.embedding[b] @ gru.w + gru.b, h @ gru.u
            r, z = sigmoid(x[:k] + hu[:k]), sigmoid(x[k : 2 * k] + hu[k : 2 * k])
            h = z * h + (1 - z) * np.tanh(x[2 * k :] + r * hu[2 * k :])
            out.append(h)
        return out

    low, rows, at = text.lower(), [], 0
    while at < len(low):
        end = len(low) if len(low) - at <= language_id.STRETCH + language_id.CONTEXT else at + language_id.STRETCH
        a, b = max(0, at - language_id.CONTEXT), min(len(low), end + language_id.CONTEXT)
        both = zip(states(model.forward, low[a:b]), states(model.backward, low[a:b][::-1])[::-1], strict=True)
        p = [np.exp(np.concatenate(fb) @ model.out + model.bias) for fb in both]
        rows += [x / x.sum() for x in p[at - a : end - a]]
        at = end
    return np.array(rows)


def test_labels_are_a_plain_forward_pass():
    rng = np.random.default_rng(3)
    model = language_id.LanguageModel.new(["a", "b", "c"])
    texts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (1, 700, 5, 1088, 1089, 2500, 64)] + [b"", b"ABC abc"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    for rows in (3, 100):
        sums, tops = language_id.label_texts(model, data, offsets, rows)
        for t, s, n in zip(texts, sums, tops, strict=True):
            p = plain_labels(model, t) if t else np.zeros((0, 3))
            assert s == pytest.approx(p.sum(0), rel=1e-3, abs=1e-3) and n.sum() == len(t)
            assert n == pytest.approx(np.bincount(p.argmax(1), minlength=3) if len(p) else np.zeros(3), abs=2)


def test_language_hard_rows(docs, empty):
    model = language_id.fit(docs, documents=60)
    got = {r.doc_id: r for r in language_id.identify_languages(docs, model).collect()}
    for i in (9001, 9002, 9003, 9009):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert got[None].held_out is False and got[9008].lang_pred in model.langs
    text = next(t for i, t in ((r.doc_id, r.text) for r in docs.where("doc_id = 9006").collect()))
    assert sum(got[9006].positions.values()) == len(text.encode())
    assert language_id.identify_languages(empty, model).count() == 0
    assert language_id.language_id_query(empty).count() == 0
    unlabelled = language_id.language_id_query(docs.limit(3).selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert len(unlabelled) == 3


def test_licenses(docs, rows):
    got = collections.defaultdict(list)
    for r in license_scan.scan_licenses(docs).collect():
        got[r.doc_id].append(r)
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        places = [(j, label) for phrase, label in license_scan.BASE.items() for p in [phrase.split()] for j in range(len(w)) if w[j : j + len(p)] == p]
        r = got[i][0]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1
    spdx = got[9012][0]
    assert spdx.labels == "bsd,gpl,mit" and spdx.expressions == "mit gpl-2.0-only classpath-exception-2.0 with or bsd-3-clause and" and spdx.permissive is True


@pytest.mark.parametrize(
    ("line", "labels"),
    [("Zlib", "zlib"), ("(MIT OR Apache-2.0) AND Zlib", "apache,mit,zlib"), ("WTFPL", "wtfpl"), ("PostgreSQL", "postgresql"), ("LicenseRef-Own-1", "licenseref-own-1"), ("(NCSA OR MIT", "mit,ncsa"), ("Artistic AND (", "artistic"), ("the file", ""), ("MPL-2.0-no-copyleft-exception", "mpl")],
)
def test_identifiers_of_tags(line, labels):
    assert license_scan.scan(f"# SPDX-License-Identifier: {line}\nint x".encode(), license_scan.automaton())[5] == labels


@pytest.mark.parametrize(
    ("text", "postfix", "met"),
    [("mit", "mit", True), ("gpl-2.0 or mit", "gpl-2.0 mit or", True), ("gpl-2.0 and mit or apache-2.0", "gpl-2.0 mit and apache-2.0 or", True), ("gpl-2.0+ and (mit or isc)", "gpl-2.0+ mit isc or and", False), ("mit and that", "mit that and", False), ("mit */ int main", "mit", True), ("(mit", "mit", True), ("mit and (", "mit", True), ("(mit or apache-2.0 and (gpl-3.0", "mit apache-2.0 gpl-3.0 and or", True), ("or mit", None, None), ("((", None, None), ("mit)", "mit", True)],
)
def test_expressions(text, postfix, met):
    got = license_scan.to_postfix(text)
    assert (got and " ".join(got)) == postfix
    if got:
        assert license_scan.evaluate(got)[1] is met


def test_long_and_neighbouring_tags():
    machine = license_scan.automaton()
    long_ = "SPDX-License-Identifier: (" + " OR ".join(["MIT"] * 150) + " OR ISC) AND MPL-2.0"
    got = license_scan.scan(long_.encode(), machine)
    assert got[5] == "isc,mit,mpl" and got[6] == 1.0 and got[8] is False
    got = license_scan.scan(b"SPDX-License-Identifier: MIT */ SPDX-License-Identifier: EPL-2.0 and SPDX-License-Identifier: ISC", machine)
    assert got[5] == "epl,isc,mit" and got[7] == "mit; epl-2.0; isc"
    assert license_scan.scan(b"SPDX-License-Identifier: see file", machine)[5:8] == ("", 0.0, None)
    assert license_scan.scan(b"SPDX-License-Identifier: MIT and that", machine)[5] == "mit"
    many = license_scan.scan(b"cc by " * 200_000, machine)
    assert many[:4] == (400_000, 200_000, 0, 399_998)


def base_secrets(t):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found)


def test_secrets(docs, rows):
    got = collections.defaultdict(list)
    for r in secret_scan.scan_secrets(docs, secret_scan.fit_automata(docs)).collect():
        got[r.doc_id].append(r)
    n = 0
    for i, t in rows:
        base = base_secrets(t)
        n += len(base)
        text = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in base)
        r = got[i][0]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in base) for j in range(3))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) - {""} <= set(r.spans.split(","))
    assert n >= 3


def test_automata_learn_formats():
    rng = np.random.default_rng(0)
    pick = lambda chars, n: bytes(rng.choice(list(chars), n).astype(np.uint8))
    keys = [b"AKIA" + pick(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16) for _ in range(200)]
    tokens = [pick(b"0123456789abcdef", 40) for _ in range(200)]
    automata = secret_scan.infer({"access": keys, "hex": tokens})
    fits = lambda v: {k for k, (a, level) in automata.items() if a.score(secret_scan.shape(v)) >= level}
    assert np.mean([bool(fits(pick(b"0123456789abcdef", 40))) for _ in range(100)]) > 0.8
    assert np.mean([bool(fits(b"AKIA" + pick(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16))) for _ in range(100)]) > 0.7
    assert not fits(b"an-ordinary-word1") and not fits(b"version_2_of_something")
    assert len([p for p in automata["hex"][0].passes]) > 2


def test_one_pass_operators_on_nothing(empty):
    assert packing.pack_documents(empty, PATH).count() == 0
    assert mixing.mix_documents(empty).count() == 0 and mixing.apply_mix(empty).count() == 0
    assert license_scan.scan_licenses(empty).count() == 0
    assert secret_scan.secret_scan_query(empty).count() == 0
