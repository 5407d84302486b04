"""Groups of spelling variants: edit distance one by dynamic programming over the sorted vocabulary."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import product

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hinted, id_and_text, tidy, written

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: The runs of letters that are words.
RUN = r"[A-Za-zÀ-ÿ]+"
TABLE_WORDS, CHUNK_WORDS, CHUNKS, TASK_CHUNKS = 200_000, 4_096, 1 << 14, 4


def _counts(rewrite: Callable[[str], Callable[[str], str]] | None, least_length: int, table_words: int) -> Callable:
    """(word, n) of a task's texts, added up in a table of bounded size before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, table = re.compile(RUN).findall, Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(table), pa.string()), pa.array(list(table.values()), pa.int64())], names=["word", "n"])
            table.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                found = Counter(find(text.as_py().lower().decode()))  # bytes.lower() changes A-Z only
                words = map(rewrite("" if doc_id is None else str(doc_id)), found) if rewrite else found
                for word, n in zip(words, found.values(), strict=True):
                    if len(word) >= least_length:
                        table[word] += n
                if len(table) > table_words:
                    yield flushed()
        yield flushed()

    return tidy(run)


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, rewrite: Callable[[str], Callable[[str], str]] | None = None, table_words: int = TABLE_WORDS) -> DataFrame:
    """word, n: the words of all texts of docs, A-Z lower-cased, of least_length code points at least, that occur least_count times at least.

    rewrite(doc_id as text) gives a function that may change the document's words. A null text has no words; a null doc_id is an empty text to rewrite; repeated rows
    count each; an empty table gives no rows."""
    parts = id_and_text(docs).mapInArrow(_counts(rewrite, least_length, table_words), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def shared(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:  # a[:low] == b[:low], a[:n] != b[:n]
        mid = (low + n) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            n = mid
    return low


def _next_rows() -> list[int]:
    """The next row of a band of one edit, for each row and each way in which a letter matches.

    A row has the edits between a list word's first d letters and the first d - 1, d and d + 1 letters of the word sought: (a, b, c), 2 for more than one. Its
    number is 8 * (3 * (3 * a + b) + c); to that add 1, 2 and 4 where the list word's next letter is the sought one's letter d, d + 1, d + 2. -1: all exceed one."""
    out = []
    for a, b, c in product(range(3), repeat=3):
        for match in range(8):
            x = min(a + (not match & 1), b + 1, 2)
            y = min(b + (not match & 2), c + 1, x + 1, 2)
            z = min(c + (not match & 4), y + 1, 2)
            out.append(-1 if x == y == z == 2 else 8 * (3 * (3 * x + y) + z))
    return out


NEXT_ROW = _next_rows()
SAME = 8 * (3 * (3 * 1 + 0) + 1)
#: Whether the cell d + 1, d or d - 1 of a row (in this order) is one edit.
ONE_EDIT = [[r // 8 // power % 3 == 1 for r in range(216)] for power in (1, 3, 9)]


class SortedWords:
    """A sorted list of different words; near() finds those within one edit of a word by one pass over it.

    The edit matrix of the word sought and a list word has three cells a row in a band of one edit. Rows of the letters that a list word shares with the one before are
    kept. A row whose cells all exceed one edit rules out all words with that prefix: the pass goes on at the next word that shares less with its predecessor."""

    def __init__(self, words: list[str]):
        self.words = words
        n = len(words)
        self.lcp = [0, *(shared(words[i - 1], words[i]) for i in range(1, n))]
        self.following = [n] * n  # the next word that shares less with its predecessor than this one does
        stack: list[int] = []
        for i in range(n):
            while stack and self.lcp[stack[-1]] > self.lcp[i]:
                self.following[stack.pop()] = i
            stack.append(i)

    def near(self, sought: str, prefix: int) -> Iterator[int]:
        """Places of the words that differ from sought by one edit and share its first `prefix` letters."""
        words, lcp, following, size, step = self.words, self.lcp, self.following, len(sought), NEXT_ROW
        head = sought[:prefix]
        i, end = bisect_left(words, head), bisect_left(words, head + "\U0010ffff")
        rows = [SAME] * (size + 3)
        padded = "\0" + sought + "\0\0\0\0"  # cells beyond sought's end count no edit that a cell within it depends on
        depth = prefix
        while i < end:
            word = words[i]
            row = rows[depth]
            length = len(word)
            for d in range(depth, length if length < size + 2 else size + 2):
                letter = word[d]
                row = step[row + (letter == padded[d]) + 2 * (letter == padded[d + 1]) + 4 * (letter == padded[d + 2])]
                if row < 0:
                    depth = d + 1
                    break
                rows[d + 1] = row
            else:
                if length > size + 1:
                    depth = size + 2
                else:
                    if length >= size - 1 and ONE_EDIT[length - size + 1][row]:
                        yield i
                    i += 1
                    if i < end:
                        depth = lcp[i]
                    continue
            # no word with these `depth` letters is near
            i += 1
            while i < end and lcp[i] >= depth:
                i = following[i]
            if i < end:
                depth = lcp[i]


def may_begin(prefix: str, sought: str) -> bool:
    """Whether a word that begins with prefix can be within one edit of sought."""
    p = shared(prefix, sought)
    left = len(prefix) - p
    return left == 0 or prefix[p + 1 :] in (sought[p + 1 : p + left], sought[p : p + left - 1]) or prefix[p:] == sought[p + 1 : p + 1 + left]


def _chunked(chunk_words: int) -> Callable:
    """Neighbours in the sorted list share a chunk: (side, chunk, key, n) of rows (side, key, n) in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, last = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            sides, chunks = batch.column(0).to_pylist(), []
            for side in sides:
                if held == chunk_words or (last is not None and side != last):
                    chunk, held = chunk + 1, 0
                held, last = held + 1, side
                chunks.append(chunk)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chunks, pa.int64()), batch.column(1), batch.column(2)], names=["side", "chunk", "key", "n"])

    return run


def _routed(directory: list[list[tuple[str, str, int]]]) -> Callable:
    """(side, chunk, key) of the words in rows (side, key), once for each chunk that may hold a near one with the same first half."""
    firsts = [[low for low, _, _ in rows] for rows in directory]
    lasts = [[high for _, high, _ in rows] for rows in directory]
    prefixes = [[low[: shared(low, high)] for low, high, _ in rows] for rows in directory]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides, chunks, keys = [], [], []
            for side, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                head = key[: (len(key) - 1) // 2]
                for i in range(bisect_left(lasts[side], head), bisect_left(firsts[side], head + "\U0010ffff")):
                    if may_begin(prefixes[side][i], key):
                        sides.append(side)
                        chunks.append(directory[side][i][2])
                        keys.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(sides, pa.int32()), pa.array(chunks, pa.int64()), pa.array(keys, pa.string())], names=["side", "chunk", "key"])

    return run


def first_half_holds(a: str, b: str) -> bool:
    """Whether two words one edit apart share half of the shorter one at the beginning; if not, they share half at the end."""
    return shared(a, b) >= min(len(a), len(b)) // 2


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n_near, best_n, best) of each word sought in a chunk, of rows (side, chunk, sought, key, n) in this order: a chunk's list comes before what is sought
    in it. A pair counts on the side on which its first halves agree, so once."""
    at, words, counts, chunk = None, [], [], None
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for side, number, sought, key, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (side, number) != at:
                at, words, counts, chunk = (side, number), [], [], None
            if not sought:
                words.append(key)
                counts.append(n)
                continue
            chunk = chunk or SortedWords(words)
            n_near, best = 0, (0, "")
            for i in chunk.near(key, (len(key) - 1) // 2):
                if side:
                    found = words[i][::-1]
                    if first_half_holds(key[::-1], found) or not first_half_holds(key, words[i]):
                        continue
                else:
                    found = words[i]
                    if not first_half_holds(key, found):
                        continue
                n_near += 1
                best = min(best, (-counts[i], found))
            if n_near:
                for column, value in zip(out, (key[::-1] if side else key, n_near, -best[0], best[1]), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """word, n_near, best_n, best of the words (columns word, n; different, not null) that differ from another by exactly one inserted, deleted or replaced
    code point: how many others, and of those the one of largest n (ties: the smallest word). An empty table gives no rows.

    Of two words one edit apart, either the first or the last halves agree. So the vocabulary is sorted twice, by the words and by the words
    reversed, and both lists are cut into chunks (of chunk_words, or as many more as keep their number under CHUNKS). A word is sought in the
    chunks that hold its first half and whose shared prefix is within one edit of it; there, SortedWords.near() passes over the list."""
    sides = words.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("key")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("key")))).alias("e"), "n").select("e.side", "e.key", "n")
    chunk_words = max(chunk_words, -(-2 * words.count() // CHUNKS))
    listed = written(sides.repartitionByRange("side", "key").sortWithinPartitions("side", "key").mapInArrow(_chunked(chunk_words), "side int, chunk long, key string, n long"), "sorted-words")
    directory: list[list[tuple[str, str, int]]] = [[], []]
    # at most CHUNKS rows and two a task
    for r in listed.groupBy("side", "chunk").agg(F.min("key").alias("low"), F.max("key").alias("high")).orderBy("side", "low").collect():
        directory[r.side].append((r.low, r.high, r.chunk))
    routed = listed.select("side", "key").mapInArrow(_routed(directory), "side int, chunk long, key string")
    rows = listed.select("side", "chunk", F.lit(False).alias("sought"), "key", "n").unionByName(routed.select("side", "chunk", F.lit(True).alias("sought"), "key", F.lit(None).cast("long").alias("n")))
    # a number of its own: the lists are small in bytes, so Spark would put many chunks, and their work, into one task
    tasks = -(-sum(map(len, directory)) // TASK_CHUNKS)
    found = rows.repartition(max(1, tasks), "side", "chunk").sortWithinPartitions("side", "chunk", "sought", "key").mapInArrow(_matched, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    out = written(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best")), "near-words")
    discard(listed)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """word, root of rows (word, form) without a cycle: the last word that following forms leads to. Each round doubles how far a row has come."""
    held = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = held.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = written(held.join(hinted(ahead, 64), "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        discard(held)
        held = step
        if held.where("moved").isEmpty():
            return held.select("word", "root")


def spelling_variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (columns word, n).

    form: the near word (see near_words()) of largest n, ties the smallest, if its n is factor times that of word at least, else null; form_n its n. root:
    the last word on the way from word over forms, word itself if it has none. Forms grow by factor (over 1), so the way is short and ends. Null words are left
    out; an empty table gives no rows; a word that stands in several rows has their sum of n. Columns besides word and n are not read."""
    if factor < 2:
        raise ValueError("factor must be 2 at least")
    held = written(words.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")
    near = near_words(held)
    joined = held.join(near, "word", "left")
    has = F.col("best_n") >= factor * F.col("n")
    marked = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), "variants")
    discard(held, near)
    ends = roots(marked.where("form is not null").select("word", "form"))
    return marked.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def one_letter_lost(doc_id: str) -> Callable[[str], str]:
    """A document's words as the query's contract has them: of about every 97th, one letter is left out."""
    begun = zlib.crc32(f"{doc_id}:".encode())

    def lost(word: str) -> str:
        h = zlib.crc32(word.encode(), begun)
        if h % 97:
            return word
        at = h % len(word)
        return word[:at] + word[at + 1 :]

    return lost


def spelling_variants_query(docs: DataFrame) -> DataFrame:
    return spelling_variants(vocabulary(docs, rewrite=one_letter_lost))
