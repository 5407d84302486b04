"""Quality classifier: importance resampling with hashed n-gram models, sampled by Gumbel top-k."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BYTE_CODES, ODD, discard, mix, powers, ship, starts_of, text_blocks, tidy, written

BUCKETS = 1 << 14
LABELLED = 20_000
SMOOTHING = 1.0
SEPARATOR, WORD, MARK = 0, 1, 2
KIND = np.full(256, MARK, np.uint8)
KIND[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = WORD
KIND[[*range(33), 127]] = SEPARATOR


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and shape of each token (a run of letters and digits, or of marks) and the rows' offsets in them.

    The shape tells marks from words, and for words whether letters are upper case at first, later, or both, digits, a length class, and
    whether the word is that before it."""
    kind = KIND[data]
    starts = np.union1d(starts_of(kind == WORD, offsets), starts_of(kind == MARK, offsets))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    up, down = powers(len(data))
    codes = BYTE_CODES[data]
    codes *= up
    codes[kind == SEPARATOR] = 0
    words = mix(np.add.reduceat(codes, starts) * down[starts])
    inside = np.add.reduceat((kind != SEPARATOR).astype(np.int32), starts)
    upper = (data >= 65) & (data <= 90)
    uppers = np.add.reduceat(upper.astype(np.int32), starts)
    digits = np.add.reduceat(((data >= 48) & (data <= 57)).astype(np.int32), starts)
    same = np.zeros(len(starts), np.uint64)
    same[1:] = words[1:] == words[:-1]
    case = np.where(uppers == 0, 0, np.where((uppers == 1) & upper[starts], 1, np.where(2 * uppers >= inside, 2, 3)))
    length = np.minimum(inside, 15).astype(np.int64) // 3
    mark = (kind[starts] == MARK).astype(np.int64)
    shape = mark + 2 * (case + 4 * ((digits > 0) + 2 * (length + 6 * mark * np.minimum(inside, 3)))) + 4096 * mark * data[starts]
    return words, shape.astype(np.uint64) * np.uint64(2) + same, np.searchsorted(starts, offsets)


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each hashed n-gram of each row: words (1, 2), and shapes (1, 2, 3), which generalise to words never seen."""
    words, shapes, at = _tokens(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    grams, rows = [], []
    for salt, (stream, n) in enumerate(((words, 1), (words, 2), (shapes, 1), (shapes, 2), (shapes, 3))):
        if len(stream) < n:
            continue
        h = np.zeros(len(stream) - n + 1, np.uint64)
        for i in range(n):
            h = h * ODD + stream[i : len(stream) - n + 1 + i] + np.uint64(1)
        inside = row[: len(h)] == row[n - 1 :]
        grams.append((mix(h ^ np.uint64(salt << 56))[inside] % np.uint64(buckets // 2)).astype(np.int64) + (buckets // 2) * (stream is shapes))
        rows.append(row[: len(h)][inside])
    return (np.concatenate(rows), np.concatenate(grams)) if grams else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _counted(good: frozenset, buckets: int) -> Callable:
    """Counts of each bucket over the task's documents, and over those of them that are labelled as good."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            wanted = np.array([i in good for i in batch.column(0).to_pylist()], bool)
            for first, data, offsets in text_blocks(batch):
                row, gram = features(data, offsets, buckets)
                raw += np.bincount(gram, minlength=buckets)
                target += np.bincount(gram[wanted[first + row]], minlength=buckets)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], names=["bucket", "raw", "target"])

    return tidy(run)


def labelled(labels: DataFrame, most: int = LABELLED) -> dict[int, int]:
    """quality by doc_id of at most `most` labelled rows, those whose hashes come first: the bounded sample that the model is fitted on."""
    rows = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("quality"))
    return {r.doc_id: r.quality for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()}


def log_ratios(docs: DataFrame, good: frozenset, buckets: int = BUCKETS) -> np.ndarray:
    """log p(bucket | good labelled documents) - log p(bucket | all documents). Word and shape buckets are one model each."""
    found = docs.select("doc_id", "text").mapInArrow(_counted(good, buckets), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.full(buckets, SMOOTHING), np.full(buckets, SMOOTHING)
    for r in found:
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    parts = [slice(0, buckets // 2), slice(buckets // 2, buckets)]
    return np.concatenate([np.log(target[p] / target[p].sum()) - np.log(raw[p] / raw[p].sum()) for p in parts])


def _scored(ratios: np.ndarray) -> Callable:
    """Rows (doc_id, text) or (row, doc_id), row being a struct with a text, as (doc_id or row, doc_id, log_ratio, n_grams): the sum of the log ratios
    of the text and its number of n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, grams = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            whole = batch.schema.names[0] == "row"
            text = batch.column(0).field("text") if whole else batch.column(1)
            for first, data, offsets in text_blocks(pa.RecordBatch.from_arrays([text], names=["text"])):
                row, gram = features(data, offsets, len(ratios))
                n = len(offsets) - 1
                score[first : first + n] = np.bincount(row, ratios[gram], minlength=n)
                grams[first : first + n] = np.bincount(row, minlength=n)
            kept = ["row", "doc_id"] if whole else ["doc_id"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(score), pa.array(grams)], names=[*kept, "log_ratio", "n_grams"])

    return tidy(run)


def calibrated(scores: DataFrame, quality: dict[int, int]) -> float:
    """The mean log ratio that best parts good from bad among the labelled sample (0 where one kind is missing)."""
    spark = scores.sparkSession
    sample = spark.createDataFrame(list(quality.items()), "doc_id long, quality int") if quality else None
    if sample is None or len(set(quality.values())) < 2:
        return 0.0
    rows = scores.join(F.broadcast(sample), "doc_id").where("n_grams > 0").groupBy("doc_id").agg(F.max(F.col("log_ratio") / F.col("n_grams")).alias("mean"), F.max("quality").alias("quality")).toPandas()
    good, bad = np.sort(rows["mean"][rows.quality == 1]), np.sort(rows["mean"][rows.quality == 0])
    if not len(good) or not len(bad):
        return 0.0
    cuts = np.unique(np.concatenate([good, bad]))
    wrong = np.searchsorted(good, cuts, "left") / len(good) * 2 + 1 - np.searchsorted(bad, cuts, "left") / len(bad)
    i = int(np.argmin(wrong))
    below = bad[bad < cuts[i]]
    return float((cuts[i] + (below[-1] if len(below) else cuts[i])) / 2)


def top_k_cut(df: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value of a column, by histograms of `bins` counts that close in on it; the driver sees only counts."""
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k >= n:
        return float("-inf")
    if k <= 0:
        return float("inf")
    above = 0
    while low < high:
        width = (high - low) / bins
        if width == 0 or low + width == low:
            break
        place = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
        inside = df.where(F.col(column).between(low, high)).groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for r in sorted(inside, key=lambda r: -r.b):
            if above + r.n >= k:
                low, high = r.lo, r.hi
                break
            above += r.n
        if above + 1 == k:
            return high
    return low


def quality_scores(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, log_ratio, n_grams, key, kept for each row of docs. kept: the row is in the Gumbel top-k sample of target-like documents.

    The target model is fitted on documents labelled quality 1 among a bounded sample of labelled_rows labels, the raw model on all
    documents. A document's importance is the sum of its n-grams' log ratios, above a level per n-gram that the labelled sample sets. k is
    the number of documents of positive importance; importance plus seeded Gumbel noise (by doc_id) ranks them, and the first k stay. Noise
    matters where importance is about 0, so clear cases are decided by text alone.
    Null or empty text has no n-grams and importance 0: chance decides, as no text is no evidence; ties at the cut all stay. A null doc_id has
    the noise of id null. Repeated rows are decided alike. No labels: the target is empty, all ratios even out and chance decides. An empty
    table gives no rows.
    """
    scores, _, level, cut = _decide(docs, labels, labelled_rows, buckets)
    return scores.select("doc_id", "log_ratio", "n_grams", _key(level).alias("key"), (_key(level) >= cut).alias("kept"))


def _key(level: float):
    u = (F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.col("log_ratio") - F.lit(level) * F.col("n_grams") - F.log(-F.log(u))


def _decide(docs: DataFrame, labels: DataFrame, labelled_rows: int, buckets: int):
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ship(docs.sparkSession)
    quality = labelled(labels, labelled_rows)
    ratios = log_ratios(source, frozenset(i for i, q in quality.items() if q == 1), buckets)
    scores = written(source.mapInArrow(_scored(ratios), "doc_id long, log_ratio double, n_grams long"), "scores")
    level = calibrated(scores, quality)
    k = scores.where(F.col("log_ratio") >= F.lit(level) * F.col("n_grams")).count()
    return scores, ratios, level, top_k_cut(scores.select(_key(level).alias("key")), "key", k)


def keep_good(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED, buckets: int = BUCKETS) -> DataFrame:
    """The rows of docs that quality_scores() keeps, with their own columns, whatever their names. Nulls, empty texts, repeated rows and empty tables are
    treated as there. Rows are scored once more where they are and filtered at the cut, so no text is shuffled."""
    scores, ratios, level, cut = _decide(docs, labels, labelled_rows, buckets)
    discard(scores)
    whole = docs.select(F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    schema = T.StructType([whole.schema["row"], whole.schema["doc_id"], T.StructField("log_ratio", T.DoubleType()), T.StructField("n_grams", T.LongType())])
    scored = whole.mapInArrow(_scored(ratios), schema)
    return scored.where(_key(level) >= cut).select("row.*")


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality_scores(docs, labels)
