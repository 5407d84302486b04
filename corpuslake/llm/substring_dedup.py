"""Substring deduplication: content-defined chunks by a gear rolling hash, deduplicated by digest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_CODES, IS_SPACE, LOWER, bloom_words, discard, fresh, hinted, id_and_text, may_hold, mix, powers, sliding, starts_of, text_blocks, tidy, word_hashes, written

WINDOW, GEAR_WORDS = 16, 3
MASK_BITS, LEAST_GAP, LONGEST, LONG_WORD = 4, 12, 192, 64
RUN_WORDS, PASSAGE_WORDS = 20, 50
GEAR = (mix(np.arange(1001, 1257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(low: np.ndarray) -> np.ndarray:
    """The gear hash at each byte: the sum of GEAR[byte] << age over the last WINDOW bytes, by doubling the window."""
    h, span = GEAR[low], 1
    while span < WINDOW:
        h = h.copy()
        h[span:] += h[:-span].copy() << np.uint32(span)
        span *= 2
    return h


def byte_cuts(low: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Cuts by bytes: one follows a byte at which the top bits of the gear hash (of WINDOW bytes in the row) are 0, unless such a byte stands among the
    LEAST_GAP before. They depend on the nearby bytes alone, so an insertion moves no cut beyond them."""
    top = gear_hashes(low) << np.uint32(32 - WINDOW) >> np.uint32(32 - MASK_BITS)
    found = np.flatnonzero(top == 0) + 1
    row = np.searchsorted(offsets, found - 1, "right") - 1
    inside = (found - offsets[row] >= WINDOW) & (found < offsets[row + 1])
    found, row = found[inside], row[inside]
    gap = np.diff(found, prepend=-LONGEST)
    near = (gap <= LEAST_GAP) & np.r_[False, row[1:] == row[:-1]][: len(row)]
    return found[~near]


def word_cuts(hashes: np.ndarray, row: np.ndarray, span: int) -> np.ndarray:
    """Words that begin a chunk: those whose gear hash, over GEAR_WORDS words, is the smallest (of equal ones, the last) of some `span` words in a row
    of the text. Each span of a text has one, and whether a word is one depends on the span - 1 words on both sides."""
    gear = hashes >> np.uint64(20)
    value = gear.copy()
    for age in range(1, GEAR_WORDS):
        same = row[age:] == row[:-age]
        value[age:][same] += gear[:-age][same] << np.uint64(age)
    value = mix(value)
    reach = np.ones(len(value), np.int64)
    for side in (-1, 1):
        open_ = np.ones(len(value), bool)
        for d in range(1, span):
            here, there = (slice(d, None), slice(None, -d)) if side < 0 else (slice(None, -d), slice(d, None))
            beaten = np.zeros(len(value), bool)
            if d < len(value):
                beaten[here] = (row[here] == row[there]) & ((value[there] >= value[here]) if side < 0 else (value[there] > value[here]))
            open_ &= beaten
            reach += open_
    return reach >= span


def sure_words(passage_words: int, span: int) -> int:
    """So many words at least lie between the first and the last cut that any two texts with a passage in common share in it."""
    return passage_words - GEAR_WORDS - 4 * (span - 1)


def span_for(passage_words: int) -> int:
    return max(1, passage_words // 7)


def chunks(data: np.ndarray, offsets: np.ndarray, span: int = PASSAGE_WORDS // 7) -> tuple[np.ndarray, ...]:
    """Row, start, end, digest and number of word starts of each chunk (bytes of the text; A-Z are lower-cased and white space is one space for the digest).

    Chunks begin at the words that word_cuts() finds, at a row's first word, and at the byte_cuts() within words of over LONG_WORD bytes; what is still longer than LONGEST is cut
    every LONGEST bytes."""
    low = LOWER[data]
    space = IS_SPACE[low]
    after_space = np.r_[True, space[:-1]][: len(space)]
    after_space[offsets[:-1][offsets[:-1] < len(space)]] = True
    place = np.flatnonzero(~(space & after_space))  # of the bytes that stay
    flat, own = low[place], np.searchsorted(place, offsets)
    flat[space[place]] = 32
    if not len(flat):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.int64))
    up, down = powers(len(flat))
    codes = BYTE_CODES[flat]
    codes *= up
    inside = flat != 32
    word = starts_of(inside, own)
    row = np.searchsorted(own, word, "right") - 1
    hashes = mix(np.add.reduceat(np.where(inside, codes, np.uint64(0)), word) * down[word])
    cuts = np.union1d(word[word_cuts(hashes, row, span)], own[:-1][np.diff(own) > 0])
    sizes = np.minimum(np.r_[word[1:], len(flat)], own[row + 1]) - word
    long_ = np.flatnonzero(sizes > LONG_WORD)
    if len(long_):
        change = np.zeros(len(flat) + 1, np.int64)
        change[word[long_] + 1] += 1
        change[word[long_] + sizes[long_]] -= 1
        found = byte_cuts(flat, own)
        cuts = np.union1d(cuts, found[np.cumsum(change)[found] > 0])
    lengths = np.diff(cuts, append=len(flat))
    wide = np.flatnonzero(lengths > LONGEST)
    if len(wide):
        cuts = np.union1d(cuts, np.concatenate([np.arange(cuts[i] + LONGEST, cuts[i] + lengths[i], LONGEST) for i in wide]))
        lengths = np.diff(cuts, append=len(flat))
    digests = mix((np.add.reduceat(codes, cuts) * down[cuts]) ^ (lengths.astype(np.uint64) << np.uint64(48)))
    words = np.diff(np.searchsorted(word, np.append(cuts, len(flat))))
    row = np.searchsorted(own, cuts, "right") - 1
    start = place[cuts]
    end = np.r_[start[1:], len(data)]
    last = np.r_[row[1:] != row[:-1], True]
    end[last] = offsets[row[last] + 1]
    return row, start, end, digests, words


def _digests(span: int) -> Callable:
    """(digest, doc_id) of the chunks, once a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, data, offsets in text_blocks(batch):
                row, _, _, digests, _ = chunks(data, offsets, span)
                order = np.lexsort((digests, row))
                r, d = row[order], digests[order]
                new = np.r_[True, (r[1:] != r[:-1]) | (d[1:] != d[:-1])][: len(r)]
                yield pa.RecordBatch.from_arrays([pa.array(d[new].view(np.int64)), pa.array(ids[first + r[new]])], names=["digest", "doc_id"])

    return tidy(run)


def _candidates(words: np.ndarray, span: int) -> Callable:
    """The chunks that the filter lets pass, with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, data, offsets in text_blocks(batch):
                row, start, end, digests, n = chunks(data, offsets, span)
                ok = may_hold(words, digests)
                row = row[ok]
                columns = [digests[ok].view(np.int64), ids[first + row], (start[ok] - offsets[row]).astype(np.int32), (end[ok] - offsets[row]).astype(np.int32), n[ok].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["digest", "doc_id", "start", "end", "words"])

    return tidy(run)


def _runs(least_words: int) -> Callable:
    """From each document's repeated chunks, the runs without a gap that have enough words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, found in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                flat = found.values.flatten()
                start, end, words, other = (x.to_numpy(zero_copy_only=False) for x in flat)
                order = np.argsort(start)
                start, end, words, other = start[order], end[order], words[order], other[order]
                firsts = np.flatnonzero(np.r_[True, start[1:] != end[:-1]])
                lasts = np.r_[firsts[1:] - 1, len(start) - 1]
                for a, b, n, o in zip(firsts, lasts, np.add.reduceat(words, firsts), np.minimum.reduceat(other, firsts), strict=True):
                    if n >= least_words:
                        out.append((doc_id, int(start[a]), int(end[b]), int(n), int(b - a + 1), int(o)))
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["doc_id", "start", "end", "words", "chunks", "first_doc_id"])

    return run


def _texts_of(words: np.ndarray) -> Callable:
    """The rows whose doc_id the filter lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield batch.filter(pa.array(may_hold(words, ids.view(np.uint64))))

    return run


WINDOWS = "doc_id long, k1 long, at int, start int, end int, chunks int, hash long"


def _windows(passage_words: int) -> Callable:
    """(doc_id, k1, at, start, end, chunks, hash) of each stretch of passage_words words that meets a run: its first word's number, its bytes and
    the run's chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = []
            held = 0
            for doc_id, text, k1, runs in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                data = np.frombuffer(text.as_py(), np.uint8)
                offsets = np.array([0, len(data)])
                whole, _ = word_hashes(data, offsets)
                if len(whole) < passage_words:
                    continue
                found = sliding(whole, passage_words)[: len(whole) - passage_words + 1]
                first, last = word_ends(data)
                chunks_ = np.zeros(len(found), np.int64)
                for r in runs:
                    a, b = np.searchsorted(first, [r["start"], r["end"]])
                    chunks_[max(0, a - passage_words) : b] = r["chunks"]
                at = np.flatnonzero(chunks_)
                out.append([np.full(len(at), doc_id, np.int64), np.full(len(at), k1, np.int64), at, first[at], last[at + passage_words - 1], chunks_[at], found[at].view(np.int64)])
                held += len(at)
                if held > 1 << 18:
                    yield _columns(out)
                    out, held = [], 0
            if out:
                yield _columns(out)

    return tidy(run)


def word_ends(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word, and the byte after its last."""
    space = IS_SPACE[data]
    return starts_of(~space, np.array([0, len(data)])), np.flatnonzero(~space & np.r_[space[1:], True]) + 1


def _columns(parts: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), kind) for x, kind in zip(zip(*parts, strict=True), kinds, strict=True)], names=["doc_id", "k1", "at", "start", "end", "chunks", "hash"])


def _whole(passage_words: int) -> Callable:
    """(k1, k2, start, end, words, chunks) of the texts (doc_id, text, k1, k2) that are long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, k1, k2 in zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                data = np.frombuffer(text.as_py(), np.uint8)
                first, last = word_ends(data)
                if len(first) >= passage_words:
                    out.append((k1, k2, int(first[0]), int(last[-1]), len(first), len(chunks(data, np.array([0, len(data)]), span_for(passage_words))[0])))
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["k1", "k2", "start", "end", "words", "chunks"])

    return run


def _spans(passage_words: int) -> Callable:
    """From each document's shared stretches, the passages: neighbouring stretches whose smallest document is the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, k1, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                at, start, end, chunks_, first = (x.to_numpy(zero_copy_only=False) for x in found.values.flatten())
                at, index = np.unique(at, return_index=True)
                start, end, chunks_, first = start[index], end[index], chunks_[index], first[index]
                firsts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (first[1:] != first[:-1])])
                lasts = np.r_[firsts[1:] - 1, len(at) - 1]
                for a, b in zip(firsts, lasts, strict=True):
                    out.append((doc_id, k1, int(start[a]), int(end[b]), int(at[b] - at[a]) + passage_words, int(chunks_[a : b + 1].max()), int(first[a])))
            columns = zip(*out, strict=True) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["doc_id", "k1", "start", "end", "words", "chunks", "first_doc_id"])

    return run


def repeated_passages(docs: DataFrame, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """doc_id, start, end, words, chunks, first_doc_id: the passages of passage_words words or more that stand in other documents too.

    start and end are bytes of the UTF-8 text. Runs of chunks whose digests each stand in two documents show where to look. A chunk begins at a word whose gear
    hash is the smallest of a span of words, so what two documents share of a passage's chunks is all but some words at each end, sure_words() of them
    at least, whatever the words are: no passage is lost. Runs from RUN_WORDS on (or that many) are verified, by the stretches of passage_words words that meet
    them, which must stand in two documents. first_doc_id is the smallest document that holds the same stretches; neighbouring stretches with the
    same first_doc_id are one passage, so passages may overlap. chunks counts those of the run. Letters A-Z count as lower case.
    Null, empty and blank text has no passage. Repetition within one document alone is none. Rows that share a doc_id are one document.
    Rows without a doc_id can't be named and are left out. An empty table gives no rows.

    Documents of one text are one text, that of the smallest of them, from there on; if it has words enough, all of it is a passage of each, and
    further passages are those that a smaller document has. Three passes over the texts: digests are pre-aggregated to their smallest and
    largest document; then only the chunks that a filter of bounded size lets pass meet the repeated digests, in a join that may split a hot
    digest; then the texts of runs are verified. What gathers by document is bounded by its length. Columns may have any names.
    """
    span = span_for(passage_words)
    source = id_and_text(docs).where("doc_id is not null").withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit(1), "text"))
    members = written(source.select("doc_id", "k1", "k2").distinct(), "members")
    copied = written(members.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).where("rep <> last").select("k1", "k2", "rep"), "copied")
    further = members.join(copied, ["k1", "k2"])
    texts = source.join(hinted(further.where("doc_id <> rep").select("doc_id", "k1", "k2"), 48), ["doc_id", "k1", "k2"], "left_anti").select("doc_id", "text", "k1", "k2")

    seen = texts.mapInArrow(_digests(span), "digest long, doc_id long").groupBy("digest").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last"))
    repeated = written(seen.where("first_doc_id <> last").select("digest", "first_doc_id"), "digests")
    places = texts.mapInArrow(_candidates(bloom_words(repeated, "digest"), span), "digest long, doc_id long, start int, end int, words int")
    found = places.join(repeated, "digest").groupBy("doc_id").agg(F.collect_set(F.struct("start", "end", "words", "first_doc_id")).alias("found"))
    runs = written(found.mapInArrow(_runs(max(1, min(RUN_WORDS, sure_words(passage_words, span)))), "doc_id long, start long, end long, words long, chunks long, first_doc_id long"), "runs")
    discard(repeated)
    by_document = runs.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end", "chunks")).alias("runs"))
    some = texts.select("doc_id", "text").mapInArrow(_texts_of(bloom_words(runs, "doc_id")), "doc_id long, text string").where("text is not null").withColumn("k1", F.xxhash64("text"))
    windows = written(some.join(by_document, "doc_id").mapInArrow(_windows(passage_words), WINDOWS), "windows")
    discard(runs)
    shared = written(windows.groupBy("hash").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last")).where("first_doc_id <> last").select("hash", "first_doc_id"), "shared")
    by_text = windows.join(shared, "hash").groupBy("doc_id", "k1").agg(F.collect_list(F.struct("at", "start", "end", "chunks", "first_doc_id")).alias("found"))
    spans = written(by_text.mapInArrow(_spans(passage_words), "doc_id long, k1 long, start long, end long, words long, chunks long, first_doc_id long"), "spans")
    discard(windows, shared)

    columns = ["doc_id", "start", "end", "words", "chunks", "first_doc_id"]
    own = spans.join(hinted(copied.select(F.col("rep").alias("doc_id"), "k1"), 32), ["doc_id", "k1"], "left_anti").select(columns)
    of_copies = spans.withColumnRenamed("doc_id", "rep").where("first_doc_id <> rep").join(further, ["k1", "rep"]).select(columns)
    whole = written(texts.join(hinted(copied.select("k1", "k2"), 32), ["k1", "k2"], "left_semi").select("doc_id", "text", "k1", "k2").mapInArrow(_whole(passage_words), "k1 long, k2 long, start long, end long, words long, chunks long").distinct(), "whole")
    return own.unionByName(of_copies).unionByName(further.withColumnRenamed("rep", "first_doc_id").join(whole, ["k1", "k2"]).select(columns))


def drop_repeats(docs: DataFrame, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """docs with repeated passages cut from all documents but the first that has them; other columns stay as they are, whatever their names. Null and empty
    texts and rows without a doc_id stay as they are; rows that share a doc_id are one document; an empty table gives no rows."""
    id_, spans_, raw_ = (fresh(x, docs) for x in ("cut_", "spans_", "raw_"))
    spans = repeated_passages(docs, passage_words).where("doc_id <> first_doc_id").groupBy(F.col("doc_id").alias(id_)).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("all_"))
    # overlapping spans are joined
    joined = F.expr("aggregate(all_, cast(array() as array<struct<start: bigint, end: bigint>>), (a, x) -> if(size(a) > 0 and x.start <= try_element_at(a, -1).end, concat(slice(a, 1, size(a) - 1), array(named_struct('start', try_element_at(a, -1).start, 'end', greatest(try_element_at(a, -1).end, x.end)))), array_append(a, x)))")
    spans = written(spans.select(id_, joined.alias(spans_)), "cuts")
    kept = F.expr(f"concat_ws('', transform(sequence(0, size({spans_})), i -> decode(substring({raw_}, if(i = 0, 1, cast({spans_}[i - 1].end as int) + 1), if(i = size({spans_}), length({raw_}), cast({spans_}[i].start as int)) - if(i = 0, 0, cast({spans_}[i - 1].end as int))), 'UTF-8')))")
    out = docs.join(hinted(spans, 128), F.col("doc_id").cast("long") == F.col(id_), "left").withColumn(raw_, F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8"))
    return out.withColumn("text", F.when(F.col(spans_).isNull(), F.col("text")).otherwise(kept)).select(*docs.columns)


def substring_dedup_query(docs: DataFrame) -> DataFrame:
    return repeated_passages(docs)
