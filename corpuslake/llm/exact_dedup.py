"""Exact deduplication with a log-structured merge index of text digests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bloom_words, fresh, hinted, id_and_text, may_hold, tidy, written

MEMTABLE_BYTES = 48 << 20
RUN_SCHEMA = "doc_id long, digest string, lo long, hi long, n long"


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
    ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
    for doc_id, text in zip(ids, texts, strict=True):
        yield doc_id, (text.as_py() or b"").lower()  # bytes.lower() changes A-Z only


def _flush(memtable_bytes: int) -> Callable:
    """A task's part of the index. A memtable maps each normalised text to its smallest and largest id and its count; a hit compares bytes,
    as the text itself is the key. A full memtable is flushed as a run sorted by digest. Also a row (n null) for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[bytes, list] = {}
        held = 0

        def flushed() -> pa.RecordBatch:
            rows = sorted((v[3], v[0], v[1], v[2]) for v in table.values())
            table.clear()
            return pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int64()), *(pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64())))], names=["doc_id", "digest", "lo", "hi", "n"])

        for batch in batches:
            ids, digests = [], []
            for doc_id, text in _texts(batch):
                entry = table.get(text)
                if entry is None:
                    entry = table[text] = [doc_id, doc_id, 0, hashlib.sha256(text).hexdigest()]
                    held += len(text) + 300
                elif doc_id is not None:
                    entry[0] = doc_id if entry[0] is None else min(entry[0], doc_id)
                    entry[1] = doc_id if entry[1] is None else max(entry[1], doc_id)
                entry[2] += 1
                ids.append(doc_id)
                digests.append(entry[3])
                if held > memtable_bytes:
                    yield flushed()
                    held = 0
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string()), none, none, none], names=["doc_id", "digest", "lo", "hi", "n"])
        if table:
            yield flushed()

    return tidy(run)


def _compacted(keep: str) -> Callable:
    """One entry (digest, keep_id, group_size, entries) for each digest of rows (digest, keep_id, n) in the order of digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        names = ["digest", "keep_id", "group_size", "entries"]
        for batch in batches:
            new = pa.table([*batch.columns, pa.array(np.ones(batch.num_rows, np.int64))], names=names)
            rows = pa.concat_tables([held, new]) if held is not None else new
            if not rows.num_rows:
                continue
            entries = rows.group_by("digest", use_threads=False).aggregate([("keep_id", "min" if keep == "smallest" else "max"), ("group_size", "sum"), ("entries", "sum")])
            entries = pa.table([entries["digest"], *(entries[c] for c in entries.column_names if c != "digest")], names=names)
            held = entries.slice(entries.num_rows - 1)
            yield from entries.slice(0, entries.num_rows - 1).to_batches()
        if held is not None:
            yield from held.to_batches()

    return run


def _hit_texts(words: np.ndarray) -> Callable:
    """Texts whose digests may be in several runs: of each, one a task and memtable's worth of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held = 0
        for batch in batches:
            found: list[tuple[str, bytes]] = []
            for _, text in _texts(batch):
                if text in seen:
                    continue
                digest = hashlib.sha256(text).hexdigest()
                if may_hold(words, np.array([int(digest[:16], 16)], np.uint64))[0]:
                    seen.add(text)
                    held += len(text)
                    found.append((digest, text))
                    if held > MEMTABLE_BYTES:
                        seen.clear()
                        held = 0
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.string()), pa.array([t for _, t in found], pa.binary())], names=["digest", "bytes"])

    return tidy(run)


def exact_duplicates(docs: DataFrame, keep: str = "smallest", memtable_bytes: int = MEMTABLE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs; texts are equal when identical after lower-casing A-Z.

    keep: "smallest" or "largest", the doc_id of a group that stays. Null text is empty, and all empty texts are one group. A null
    doc_id stays only where its whole group has none. Rows repeated with one doc_id and text count each in group_size and share the
    decision (kept is true on each of them if their id stays). An empty table gives no rows.

    1. Flush: each task fills memtables of bounded size and flushes them as runs sorted by digest, one entry a text and memtable: copies
       meet there first, so a hot group leaves a task as one row. 2. Compaction: runs are dealt by digest and merged in order, neighbours of one
       digest becoming one entry with the smallest (or largest) id. 3. Verification: a filter over the digests that stand in several entries
       (sized by their number, 16 MB at most) picks the texts to read again; of each, all bytes must be equal. Were they not, texts of that
       digest would be grouped by the bytes themselves.
    """
    source = id_and_text(docs)
    flushed = written(source.mapInArrow(_flush(memtable_bytes), RUN_SCHEMA), "runs")
    rows, runs = flushed.where("n is null").select("doc_id", "digest"), flushed.where("n is not null")
    runs = runs.select("digest", F.col("lo" if keep == "smallest" else "hi").alias("keep_id"), "n")
    merged = runs.repartition("digest").sortWithinPartitions("digest").mapInArrow(_compacted(keep), "digest string, keep_id long, group_size long, entries long")
    groups = written(merged.where("group_size > 1"), "compacted")
    hits = groups.where("entries > 1").select(F.expr("cast(conv(substring(digest, 1, 16), 16, -10) as long)").alias("key"))
    texts = source.mapInArrow(_hit_texts(bloom_words(hits, "key")), "digest string, bytes binary")
    unequal = texts.groupBy("digest").agg(F.min("bytes").alias("a"), F.max("bytes").alias("b")).where("a <> b").select("digest")
    if not unequal.isEmpty():
        return _by_bytes(source, keep)
    joined = rows.join(groups, "digest", "left")
    keep_id = F.coalesce("keep_id", "doc_id")
    return joined.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), F.col("digest").alias("text_sha256"))


def _by_bytes(source: DataFrame, keep: str) -> DataFrame:
    """The same, grouped by whole normalised texts: for tables in which two texts share a digest."""
    low = F.expr("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    rows = source.select("doc_id", low.alias("low"))
    groups = written(rows.groupBy("low").agg((F.min if keep == "smallest" else F.max)("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "compacted")
    return rows.join(groups, "low").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.sha2("low", 256).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """docs, with its own columns, without the rows that exact_duplicates() drops; of rows repeated with one doc_id and text, one stays.

    Null text counts as empty; rows of a null doc_id are told apart by their texts. An empty table gives no rows. Columns may have any names. Texts stay
    where they are while the rows decided on are few enough to broadcast (see hinted())."""
    id_, sha, kept, n, own = (fresh(x, docs) for x in ("id_", "sha_", "kept_", "rows_", "own_"))
    decided = exact_duplicates(docs, keep).where("group_size > 1").groupBy(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha)).agg(F.max("kept").alias(kept), F.count("*").alias(n))
    decided = written(decided.where(~F.col(kept) | (F.col(n) > 1)), "decided")
    repeated = decided.where(F.col(kept)).select(id_, sha)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(sha))
    marked = docs.withColumn(own, F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), 256))
    out = marked.join(hinted(decided.select(id_, sha), 128), same, "left_anti").select(*docs.columns)
    if repeated.isEmpty():
        return out
    return out.unionByName(marked.join(hinted(repeated, 128), same, "left_semi").dropDuplicates(["doc_id", own]).select(*docs.columns))


def exact_dedup_query(docs: DataFrame) -> DataFrame:
    return exact_duplicates(docs, keep="largest")


EXACT_DEDUP_SQL = """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from documents)
select doc_id, max(doc_id) over (partition by low) as keep_id, count(*) over (partition by low) as group_size,
  doc_id = max(doc_id) over (partition by low) as kept, sha256(low) as text_sha256
from t
"""
