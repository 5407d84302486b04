"""Packing tokenised documents into training sequences by cutting-stock column generation."""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, tidy, written

CAPACITY, UNIT, END_ID = 2048, 8, 1
CACHE_WORDS = 150_000
#: ASCII punctuation that the tokenizer always parts from a letter or digit before it. The apostrophe is not among them.
TAIL = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
TAILED = re.compile(rb"(?<=[0-9A-Za-z])(?=[" + re.escape(TAIL) + rb"]+(?:\s|\Z))")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bin int, part int, place long"


def byte_alphabet() -> str:
    """The printable character that byte-level BPE has for each byte: itself if printable in Latin-1, else the next from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return "".join(chr(b if b in printable else next(spare)) for b in range(256))


def little(ids: Iterable[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class WordTokenizer:
    """Token ids of texts as little-endian uint32 bytes, word by word.

    White space parts words for this tokenizer, so a text's ids are its words' ids joined; most words were seen before. A text with
    combining marks, in which lower-casing first may change composition, is encoded whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.model = self.whole.model
        self.alphabet = byte_alphabet()
        self.words: dict[bytes, bytes] = {}

    def _encoded(self, text: str) -> bytes:
        return little(self.whole.encode(text, add_special_tokens=False).ids)

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if text.isalpha():
            if text.isascii():
                return little([t.id for t in self.model.tokenize(text)])
            if max(text) < "ɐ" and text == text.lower() and unicodedata.is_normalized("NFC", text):
                return little([t.id for t in self.model.tokenize("".join(map(self.alphabet.__getitem__, word)))])
        return self._encoded(text)

    def ids(self, text: bytes) -> bytes:
        if b"\xcc" in text or b"\xcd" in text:
            return self._encoded(text.decode())
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        words = TAILED.sub(b" ", text.lower()).split()
        found = list(map(self.words.get, words))
        if None in found:
            for word in {word for word, ids in zip(words, found, strict=True) if ids is None}:
                self.words[word] = self._word(word)
            found = map(self.words.__getitem__, words)
        return b"".join(found)


def _pieces(path: str, capacity: int, unit: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part = WordTokenizer(path), TaskContext.get().partitionId()
        end = np.array([END_ID], "<u4").tobytes()
        placed = np.zeros(capacity // unit + 1, np.int64)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            rows: list[tuple] = []
            for doc_id, text in zip(ids, texts, strict=True):
                coded = tokenizer.ids(text.as_py()) + end
                n = len(coded) // 4
                for start in range(0, n, capacity):
                    piece = coded[4 * start : 4 * (start + capacity)]
                    length = len(piece) // 4
                    size = -(-length // unit)
                    rows.append((doc_id, start, length, zlib.crc32(piece), n, size, part, int(placed[size])))
                    placed[size] += 1
            columns = zip(*rows, strict=True) if rows else [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin", "part", "place"])

    return tidy(run)


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the multiset of sizes (ascending) of the greatest value that fits."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    n_fit = np.searchsorted(sizes, np.arange(capacity + 1), "right")
    for w in range(1, capacity + 1):
        best[w] = best[w - 1]
        if n := n_fit[w]:
            total = best[w - sizes[:n]] + values[:n]
            i = total.argmax()
            if total[i] > best[w] + 1e-12:
                best[w], last[w] = total[i], i
    pattern, w = np.zeros(len(sizes)), capacity
    while w > 0:
        if last[w] < 0:
            w -= 1
        else:
            pattern[last[w]] += 1
            w -= int(sizes[last[w]])
    return float(best[capacity]), pattern


def column_generation(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 3000, gap: float = 5e-4) -> list[tuple[np.ndarray, float]]:
    """Fewest sequences (fractions allowed) that hold counts[i] pieces of sizes[i]: patterns and how often each is used.

    Simplex on the patterns of the basis; the knapsack prices new ones by the dual values. A surplus column (cost 0) enters where a dual
    value is negative. It ends at the optimum, or within `gap` of the lower bound that the dual values and the best pattern give."""
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    cost = np.ones(m)
    for _ in range(rounds):
        used = np.linalg.solve(basis, counts.astype(float))
        dual = np.linalg.solve(basis.T, cost)
        if dual.min() < -1e-9:
            column, price = np.zeros(m), 0.0
            column[int(np.argmin(dual))] = -1
        else:
            value, column = best_pattern(dual, sizes, capacity)
            price = 1.0
            if value <= 1 + 1e-7 or (cost @ used) - (dual @ counts) / value < gap * (cost @ used):
                break
        change = np.linalg.solve(basis, column)
        ahead = change > 1e-9
        if not ahead.any():
            break
        ratio = np.where(ahead, np.maximum(used, 0) / np.where(ahead, change, 1), np.inf)
        out = int(np.argmin(ratio))
        basis[:, out], cost[out] = column, price
    used = np.linalg.solve(basis, counts.astype(float))
    return [(basis[:, j], float(used[j])) for j in range(m) if cost[j] and used[j] > 1e-9]


def whole_patterns(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """Patterns and whole numbers of uses that hold all pieces: the linear program's rounded down, then first-fit decreasing on what is left."""
    left, out = counts.astype(np.int64).copy(), []
    if not len(sizes):
        return out
    for pattern, used in sorted(column_generation(sizes, counts, capacity), key=lambda x: -x[1]):
        items = pattern.round().astype(np.int64)
        held = items > 0
        times = min(int(used + 1e-6), int((left[held] // items[held]).min()))
        if times > 0:
            left -= times * items
            out.append((times, items))
    while left.any():
        items, room = np.zeros(len(sizes), np.int64), capacity
        for i in np.argsort(-sizes):
            n = min(int(left[i]), room // int(sizes[i]))
            items[i], room = n, room - n * int(sizes[i])
        held = items > 0
        times = int((left[held] // items[held]).min())
        left -= times * items
        out.append((times, items))
    return out


def _assigned(plan: dict[int, tuple[np.ndarray, ...]]) -> Callable:
    """The sequence and the slot of each piece from its rank within its bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, ranks = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("bin", "rank"))
            sequence, slot = np.zeros(len(bins), np.int64), np.zeros(len(bins), np.int64)
            for b in np.unique(bins):
                rows = bins == b
                low, each, first = plan[int(b)]
                at = np.searchsorted(low, ranks[rows], "right") - 1
                inner = ranks[rows] - low[at]
                sequence[rows], slot[rows] = first[at] + inner // each[at], inner % each[at]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(slot)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin", "sequence_id", "slot"])

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece of each row of docs.

    A document (null text: empty) is its token ids and then id 1; it is cut after every `capacity` ids, so only documents longer than a
    sequence are cut, and only their last piece shares a sequence. Each id lies in one piece, and pieces lie in their sequence without
    gaps. An empty text is one piece of length 1; a null doc_id is carried along; repeated rows are packed each; an empty table gives no rows.

    The driver sees only a histogram of lengths in units of `unit` ids (capacity / unit counts at most, however many documents) and solves
    the cutting-stock linear program on it. Pieces are ranked within their bin by prefix sums of the tasks' counts, and a rank gives
    pattern, copy and slot; the only shuffle of pieces is by sequence.
    """
    if capacity % unit:
        raise ValueError("unit must divide capacity")
    schema = PIECES
    pieces = written(id_and_text(docs).mapInArrow(_pieces(tokenizer_path, capacity, unit), schema), "pieces")
    parts = pieces.groupBy("part", "bin").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(parts.select("part", "bin", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "ranks")
    histogram = sorted((r.bin, r.n) for r in bases.groupBy("bin").agg(F.sum("n").alias("n")).collect())
    sizes, counts = np.array([b for b, _ in histogram], np.int64), np.array([n for _, n in histogram], np.int64)
    slots: dict[int, list[tuple[int, int, int]]] = {int(b): [] for b in sizes}
    filled, first = dict.fromkeys(slots, 0), 0
    for times, items in whole_patterns(sizes, counts, capacity // unit):
        for b, n in zip(map(int, sizes), map(int, items), strict=True):
            if n:
                slots[b].append((filled[b], n, first))
                filled[b] += n * times
        first += times
    plan = {b: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for b, rows in slots.items()}
    ranked = pieces.join(bases.select("part", "bin", "base"), ["part", "bin"]).withColumn("rank", F.col("base") + F.col("place"))
    placed = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin", "rank").mapInArrow(_assigned(plan), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bin int, sequence_id long, slot long")
    ahead = Window.partitionBy("sequence_id").orderBy(F.desc("bin"), "slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset"))


def packing_query(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
