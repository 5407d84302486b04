"""Token files, spelling variants and periodic runs against plain versions."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpuslake.llm import periodic_runs, spelling_variants, token_output

from .conftest import lower

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def whole():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda t: tokenizer.encode(t, add_special_tokens=False).ids


def test_byte_tokenizer_is_the_tokenizer(whole):
    mine = token_output.ByteTokenizer(PATH)
    hard = ["", " ", "  a", "a  b", "a \n b", "a \n\n  b ", "don't we'll 'tis 's it 's", "x  y  z", "a  b", "a\x85 b\x1c c", "é è\nÀ ×÷", "<|endoftext|> b", "3.14 a1b2 --- ***!", "日本 語 テ", "да нет", "\t\ttab \r\n", "é x", "a  b", "🙂 🙂🙂 ok", "a\n\t\tb", "\n", "\n a\nb\n", "a\t\t\nb"]
    pick = random.Random(7)
    letters = [" ", " ", " ", "\n", "a", "b", "é", "'", "s", "t", ".", "1", " ", " ", "语", "\t", "д", "\x1f", "ß"]
    hard += ["".join(pick.choices(letters, k=pick.randint(0, 14))) for _ in range(12000)]
    for t in hard:
        assert np.frombuffer(mine.ids(t.encode()), "<u4").tolist() == whole(t), repr(t)


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    pick = np.random.default_rng(1)
    for ids in ([], [0], [0] * 9, [1], [2**32 - 1, 0], pick.integers(0, 50257, 1001), pick.integers(0, 2**32, 77), [256] * 3):
        ids = np.array(ids, np.uint32)
        planes = token_output.to_planes(ids, bits)
        assert token_output.from_planes(planes, len(ids), bits).tolist() == ids.tolist()
        if len(ids):
            assert len(planes) == -(-int(ids.max()).bit_length() // (1 if bits else 8))


def test_joined_crc():
    pick = random.Random(2)
    for n, m in [(0, 0), (0, 5), (5, 0), (1, 1), (100, 4096), (7, 100001)]:
        a, b = pick.randbytes(n), pick.randbytes(m)
        assert token_output.joined_crc(zlib.crc32(a), zlib.crc32(b), m) == zlib.crc32(a + b)


def expected_tokens(rows, whole, end=0):
    """(doc_id, ids) in the order of the files, for rows whose doc_id is theirs alone."""
    return [(i, [*whole(t), end]) for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]


@pytest.mark.parametrize("bits, block", [(False, 65536), (True, 100), (False, 7)])
def test_token_files(spark, docs, rows, whole, bits, block):
    some = docs if block > 7 else docs.where("doc_id >= 9000 and doc_id <> 9008 or doc_id is null")
    held = [(i, t) for i, t in rows if block > 7 or i is None or (i >= 9000 and i != 9008)]
    files = token_output.write_token_ids(some, PATH, block_ids=block, bits=bits)
    want = expected_tokens(held, whole)
    flat, start, checks = [], 0, collections.Counter()
    for i, ids in want:
        checks[i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        flat += ids
        start += len(ids)
    got = collections.Counter(tuple(r) for r in token_output.token_checksums(spark, files).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == checks
    index = sorted(token_output.chunk_index(spark, files).collect(), key=lambda r: r.start)
    assert [r.start for r in index] == np.cumsum([0, *(r.n_ids for r in index)])[:-1].tolist() and sum(r.n_ids for r in index) == len(flat)
    assert max(r.n_ids for r in index) <= block
    for low, high in [(0, 1), (5, 777), (len(flat) - 3, len(flat) + 9), (4, 4)]:
        parts = sorted(token_output.read_range(spark, files, low, high).collect())
        assert [x for p in parts for x in p.ids] == flat[low:high]
    by_doc = collections.defaultdict(list)
    for r in token_output.read_pieces(spark, files).collect():
        by_doc[r.doc_id, r.start].append((r.at, r.ids))
    assert sorted(sum((ids for _, ids in sorted(p)), []) for p in by_doc.values()) == sorted(ids for _, ids in want)
    token_output.drop_files(spark, files)


def test_token_output_query(spark, docs, rows, whole, empty):
    got = token_output.token_output_query(docs).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == sorted((i or -1, len(whole(t)) + 1) for i, t in rows)
    assert token_output.token_output_query(empty).collect() == []


def plain_words(rows):
    counts = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain_variants(vocabulary):
    """Each word's near ones by all their one-letter deletions, checked by the definition."""
    holes = collections.defaultdict(set)
    for w in vocabulary:
        for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            holes[key].add(w)

    def one_edit(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w, n in vocabulary.items():
        near = {x for key in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for x in holes[key] if one_edit(w, x)}
        form = min(near, key=lambda x: (-vocabulary[x], x), default=None)
        if form is not None and vocabulary[form] < 2 * n:
            form = None
        out[w] = [form, n, len(near), vocabulary.get(form)]
    for w, row in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        out[w] = (row[0], root, *row[1:])
    return out


def test_sorted_words_pass():
    pick = random.Random(3)
    for letters, longest in (("ab", 7), ("abcdé", 6), ("abcdefgh", 5)):
        words = sorted({"".join(pick.choices(letters, k=pick.randint(1, longest))) for _ in range(400)})
        table = spelling_variants.SortedWords(words)
        near = {w: set() for w in words}
        for w in words:
            near[w] = {x for x in words if x != w and (x in [w[:i] + w[i + 1 :] for i in range(len(w))] or w in [x[:i] + x[i + 1 :] for i in range(len(x))] or (len(x) == len(w) and sum(a != b for a, b in zip(x, w, strict=True)) == 1))}
        for w in words:
            assert {words[i] for i in table.near(w, 0)} == near[w]
            for k in range(1, len(w) + 1):
                assert {words[i] for i in table.near(w, k)} == {x for x in near[w] if x[:k] == w[:k]}
            for x in near[w]:
                assert all(spelling_variants.may_begin(x[:k], w) for k in range(len(x) + 1))
                assert spelling_variants.first_half_holds(w, x) or spelling_variants.first_half_holds(w[::-1], x[::-1])


def test_spelling_variants(spark, docs, rows, empty):
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants.spelling_variants_query(docs).collect()}
    want = plain_variants(plain_words(rows))
    assert got == want and any(r[0] for r in want.values())
    assert spelling_variants.spelling_variants_query(empty).collect() == []


def test_spelling_variants_in_small_chunks(spark, monkeypatch):
    """Long chains of forms, chunks of a few words, one first half that all words share, repeated rows and a null word."""
    pick = random.Random(5)
    vocabulary = {"co" + "".join(pick.choices("abcé", k=pick.randint(3, 5))): 3 * 2 ** pick.randint(0, 12) for _ in range(700)}
    vocabulary |= {"z" * k: 3 * 2**k for k in range(5, 25)}
    words = spark.createDataFrame([*vocabulary.items(), ("abcdefg", 2), ("abcdefg", 3), (None, 4)], "word string, n long")
    near, chunks = spelling_variants.near_words, []
    monkeypatch.setattr(spelling_variants, "near_words", lambda w: near(w, chunk_words=16))
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants.spelling_variants(words).collect()}
    assert got == plain_variants(vocabulary | {"abcdefg": 5}) and not chunks
    assert got["zzzzz"][1] == "z" * 24


def plain_runs(words, least=6, exponent=4):
    """For each period the stretches of words that equal those a period on; of one stretch, the smallest period."""
    numbers, found = {}, {}
    symbols = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int32)
    for q in range(1, len(words) // exponent + 1):
        edges = np.flatnonzero(np.diff(np.r_[False, symbols[:-q] == symbols[q:], False].astype(np.int8)))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if e + q - s >= max(least, exponent * q):
                found.setdefault((s, e + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_periodic(i, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, h = len(words), zlib.crc32(str(i).encode())
    if i is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k if k < a else a + (k - a) % p] for k in range(n)]
    runs = plain_runs(words)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-(r[1] * 10**9 // r[2]), r[0], r[2]), default=None)
    kept = " ".join(w for k, w in enumerate(words) if k not in gone)
    return (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_find_runs():
    pick = random.Random(11)
    for trial in range(300):
        texts = []
        for _ in range(pick.randint(1, 5)):
            text = [pick.choice("ab" if trial % 2 else "abcde") for _ in range(pick.randint(0, 60))]
            for _ in range(pick.randint(0, 3)):
                part = [pick.choice("abc") for _ in range(pick.randint(1, 6))] * pick.randint(1, 7)
                at = pick.randint(0, len(text))
                text[at:at] = part[: pick.randint(0, len(part))]
            texts.append(text)
        numbers = {}
        symbols = np.array([numbers.setdefault((k, w), len(numbers)) for k, t in enumerate(texts) for w in t], np.int64)
        for least, exponent in ((6, 4), (1, 2), (1, 3)):
            starts, ends, periods = periodic_runs.find_runs(symbols, np.array([len(t) for t in texts]), least, exponent)
            want, at = [], 0
            for t in texts:
                want += [(s + at, s + at + length, q) for s, length, q in plain_runs(t, least, exponent)]
                at += len(t)
            assert list(zip(starts.tolist(), ends.tolist(), periods.tolist(), strict=True)) == want


def test_periodic_runs(spark, docs, rows, empty):
    got = collections.defaultdict(list)
    for r in periodic_runs.periodic_runs_query(docs).collect():
        got[r.doc_id].append((r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256))
    want = collections.defaultdict(list)
    for i, t in rows:
        want[i].append(plain_periodic(i, t))
    assert set(got) == set(want)
    for i in want:
        assert sorted(map(repr, got[i])) == sorted(map(repr, want[i])), i
    assert sum(w[0][0] > 0 for w in want.values()) > 10
    assert periodic_runs.periodic_runs_query(empty).collect() == []
    kept = {r.doc_id: r.text for r in periodic_runs.collapse_runs(docs).collect()}
    assert kept[9008] == "word and other words" and kept[9001] == ""
