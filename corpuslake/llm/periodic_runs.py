"""Periodic runs of words, by an enhanced suffix array and the branching-tandem test on its LCP intervals."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, tidy

LEAST_WORDS, LEAST_EXPONENT = 6, 4
BLOCK_WORDS, PAIRS = 1 << 16, 1 << 20


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, and the ranks by the first 2**k symbols for each k, by prefix doubling: only suffixes that still tie are sorted again.

    symbols are dense numbers from 0; an end ranks before every symbol."""
    n = len(symbols)
    rank = np.full(n + 1, -1, np.int64)
    order = np.argsort(symbols, kind="stable")
    new = np.r_[True, symbols[order[1:]] != symbols[order[:-1]]]
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]  # the first place of its group
    levels, step = [rank.copy()], 1
    while True:
        tied = ~(new & np.r_[new[1:], True])  # places in groups of more than one
        places = np.flatnonzero(tied)
        if not len(places):
            return order, levels
        suffixes = order[places]
        after = rank[np.minimum(suffixes + step, n)]
        key = np.lexsort((after, rank[suffixes]))
        suffixes, after, group = suffixes[key], after[key], rank[suffixes[key]]
        order[places] = suffixes
        first = np.r_[True, (group[1:] != group[:-1]) | (after[1:] != after[:-1])]
        new[places] = first
        rank[suffixes] = places[np.flatnonzero(first)[np.cumsum(first) - 1]]
        levels.append(rank.copy())
        step *= 2


def common_prefixes(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Length of the longest common prefix of suffixes a[i] and b[i] (different ones), from the ranks of doubled lengths."""
    n, out = len(levels[0]) - 1, np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = np.minimum(a + out, n), np.minimum(b + out, n)
        same = (levels[k][x] == levels[k][y]) & (x < n) & (y < n)
        out += same.astype(np.int64) << k
    return out


def extended_left(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """How far the symbols before a[i] and before b[i] > a[i] are the same."""
    out = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a - out - (1 << k), b - out - (1 << k)
        same = x >= 0
        same[same] = levels[k][x[same]] == levels[k][y[same]]
        out += same.astype(np.int64) << k
    return out


def smaller_neighbours(lcp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in at: the nearest place before and after it with a smaller value (lcp[0] is smaller than all; after the last one, len(lcp)),
    by descent over the minima of doubled ranges."""
    minima = [np.append(lcp, -1)]
    n = len(minima[0])
    while (1 << len(minima)) < n:
        below, half = minima[-1], 1 << (len(minima) - 1)
        above = np.full(n, -1, lcp.dtype)
        above[: n - half] = np.minimum(below[: n - half], below[half:])
        minima.append(above)
        if not (above > 0).any():  # no value above 0 stands in a longer range
            break
    value, before, after = lcp[at], at - 1, at + 1
    for k in range(len(minima) - 1, -1, -1):
        low = before - (1 << k) + 1  # minima[k][low] is that of low .. before
        jump = (low >= 0) & (minima[k][np.maximum(low, 0)] >= value)
        before = before - (jump.astype(np.int64) << k)
        jump = (after < n) & (minima[k][np.minimum(after, n - 1)] >= value)
        after = after + (jump.astype(np.int64) << k)
    return before, after


def branching_tandems(order: np.ndarray, lcp: np.ndarray, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and half lengths of the squares that no next symbol continues.

    Each LCP interval (depth d) is parted into children by the places at which lcp is d. For every suffix i of its children but the largest, i + d
    and i - d are looked up: if they lie in the interval but not in the child of i, the two suffixes share d symbols exactly, and the square
    of half length d starts at the smaller one. longest: half lengths beyond it, for each suffix, are not asked for."""
    n = len(order)
    inverse = np.empty(n + 1, np.int64)
    inverse[order], inverse[n] = np.arange(n), -1
    at = np.flatnonzero((lcp > 0) & (lcp <= longest[order]))
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none
    before, after = smaller_neighbours(lcp, at)
    key = np.lexsort((at, after, before))
    at, low, high = at[key], before[key], after[key] - 1  # the interval: places low .. high of the suffix array
    depth = lcp[at]
    head = np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])]
    interval = np.cumsum(head) - 1
    first = np.flatnonzero(head)
    # children: one before each boundary, and one after an interval's last boundary
    child_low = np.r_[np.where(head, low, np.r_[0, at[:-1]]), at[np.r_[first[1:], len(at)] - 1]]
    child_high = np.r_[at - 1, high[first]]
    owner = np.r_[interval, np.arange(len(first))]
    sizes = child_high - child_low + 1
    by_size = np.lexsort((sizes, owner))
    largest = np.zeros(len(sizes), bool)
    largest[by_size[np.r_[owner[by_size][1:] != owner[by_size][:-1], True]]] = True
    small = np.flatnonzero(~largest)
    starts, halves = [], []
    ends = np.cumsum(sizes[small])
    done = 0
    while done < len(small):  # in portions of about PAIRS suffixes
        stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS, "right")))
        some = small[done:stop]
        count = sizes[some]
        child = np.repeat(some, count)
        places = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + child_low[child]
        head_of = first[owner[child]]
        suffix, d = order[places], depth[head_of]
        for other, start in ((suffix + d, suffix), (suffix - d, suffix - d)):
            place = inverse[np.where((other >= 0) & (other < n), other, n)]
            hit = (place >= low[head_of]) & (place <= high[head_of]) & ((place < child_low[child]) | (place > child_high[child]))
            starts.append(start[hit])
            halves.append(d[hit])
        done = stop
    return np.concatenate(starts), np.concatenate(halves)


def find_runs(symbols: np.ndarray, lengths: np.ndarray, least: int = LEAST_WORDS, exponent: int = LEAST_EXPONENT) -> tuple[np.ndarray, ...]:
    """Start, end and smallest period of the runs of at least max(least, exponent * period) symbols, by start and period.

    symbols are those of several texts, one after the other (lengths); no symbol stands in two of them, so nothing repeats across texts."""
    none = np.zeros(0, np.int64)
    if not len(symbols):
        return none, none, none
    order, levels = suffix_array(symbols)
    lcp = np.zeros(len(order), np.int64)
    lcp[1:] = common_prefixes(order[1:], order[:-1], levels)
    starts, periods = branching_tandems(order, lcp, np.repeat(lengths // exponent, lengths))
    ends = starts + 2 * periods
    starts = starts - extended_left(starts, starts + periods, levels)  # the square rotated to the left as far as it goes
    long_ = ends - starts >= np.maximum(least, exponent * periods)
    starts, ends, periods = starts[long_], ends[long_], periods[long_]
    key = np.lexsort((periods, ends, starts))
    starts, ends, periods = starts[key], ends[key], periods[key]
    # a stretch found with several periods has the smallest one
    new = np.r_[True, (starts[1:] != starts[:-1]) | (ends[1:] != ends[:-1])][: len(starts)]
    starts, ends, periods = starts[new], ends[new], periods[new]
    key = np.lexsort((periods, starts))
    return starts[key], ends[key], periods[key]


def _runs(least: int, exponent: int) -> Callable:
    names = ["doc_id", "n_words", "runs", "collapsed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            words: list[list[bytes]] = []
            first, held = 0, 0
            for i in range(batch.num_rows):
                words.append(texts[i].as_py().split())  # at ASCII white space
                held += len(words[-1])
                if held >= BLOCK_WORDS or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(words)), *_block(words, least, exponent)], names=names)
                    words, first, held = [], i + 1, 0

    return tidy(run)


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _block(words: list[list[bytes]], least: int, exponent: int) -> list[pa.Array]:
    lengths = np.array([len(w) for w in words], np.int64)
    offsets = np.r_[0, np.cumsum(lengths)]
    symbols, base = np.empty(offsets[-1], np.int64), 0
    for i, text in enumerate(words):
        numbers: dict[bytes, int] = {}
        symbols[offsets[i] : offsets[i + 1]] = [numbers.setdefault(w, base + len(numbers)) for w in text]
        base += len(numbers)
    starts, ends, periods = find_runs(symbols, lengths, least, exponent)
    row = np.searchsorted(offsets, starts, "right") - 1
    change = np.zeros(offsets[-1] + 1, np.int64)
    np.add.at(change, starts + periods, 1)
    np.add.at(change, ends, -1)
    dropped = np.cumsum(change) > 0
    collapsed = []
    touched = set(row.tolist())
    for i, text in enumerate(words):
        if i in touched:
            text = [w for w, gone in zip(text, dropped[offsets[i] : offsets[i + 1]].tolist(), strict=True) if not gone]
        collapsed.append(b" ".join(text))
    runs = pa.StructArray.from_arrays([pa.array(starts - offsets[row]), pa.array(ends - starts), pa.array(periods)], fields=list(RUN))
    cuts = pa.array(np.searchsorted(row, np.arange(len(words) + 1)).astype(np.int32))
    return [pa.array(lengths), pa.ListArray.from_arrays(cuts, runs), pa.array(collapsed, pa.binary()).cast(pa.string())]


def periodic_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start and period), collapsed (the text without its runs' repeats) of each row of docs.

    Words are the runs of characters that are no ASCII white space. A run is a stretch of words with smallest period q, of max(least_words,
    least_exponent * q) words at least, that no neighbouring word continues. A word that some run contains after that run's first q words is left out of collapsed;
    the kept words stand with one space between. least_exponent is 2 at least: a run's rightmost square must lie in it.

    A null text is empty: no words, no runs, an empty collapsed text. Rows repeated with one doc_id, and rows without one, are read each by itself; an
    empty table gives no rows; columns besides doc_id and text are not read. There is no shuffle, so many copies of a text cost as many readings. Texts are read whole, in blocks of about BLOCK_WORDS words; a longer text is a block of its own, with some 8 bytes a
    word for each doubling up to its longest repeat.
    """
    if least_exponent < 2:
        raise ValueError("least_exponent must be 2 at least")
    return id_and_text(docs).mapInArrow(_runs(least_words, least_exponent), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def collapse_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """doc_id, text of each row of docs: its words with one space between, periodic runs cut to their first period. Null texts are empty."""
    return periodic_runs(docs, least_words, least_exponent).select("doc_id", F.col("collapsed").alias("text"))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id, text: of every tenth document by crc32, the words from one on repeat with a period, as the query's contract lays down. A row
    without a doc_id, or with no word, keeps its text."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    planted = F.transform("i_words", lambda _, i: F.when(i < F.col("i_a"), F.get("i_words", i)).otherwise(F.get("i_words", (F.col("i_a") + (i - F.col("i_a")) % F.col("i_p")).cast("int"))))
    rows = id_and_text(docs).withColumn("i_h", h)
    chosen = (F.col("i_h") % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    rows = rows.withColumn("i_words", F.when(chosen, words)).withColumn("i_n", F.size("i_words")).withColumn("i_g", F.floor(F.col("i_h") / 10))
    rows = rows.withColumn("i_a", F.when(chosen, F.col("i_g") % F.col("i_n"))).withColumn("i_p", F.when(chosen, 1 + F.floor((F.col("i_n") - F.col("i_a")) / (3 + F.col("i_g") % 8))))
    return rows.select("doc_id", F.when(chosen, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def periodic_runs_query(docs: DataFrame) -> DataFrame:
    """The runs of documents with planted periods as digests, and the run of the greatest exponent."""
    found = periodic_runs(with_planted_periods(docs))
    # exponents are compared exactly, as length * period of the other
    better = "aggregate(runs, cast(null as struct<start: long, length: long, period: long>), (a, r) -> case when a is null or r.length * a.period > a.length * r.period then r else a end)"
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    found = found.withColumn("best", F.expr(better))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
