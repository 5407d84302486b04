"""Helpers that several operators share: written tables, Arrow text access, word hashes."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, ship

def tidy(run: Callable) -> Callable:
    """run, a function over record batches, and after its last batch give freed memory back: a worker waits for its next task beside others."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return outer


WHITE_SPACE = b" \t\n\x0b\x0c\r"
BLOCK_BYTES = 1 << 19


_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
SMALL_ROWS = 1 << 20


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df once as a Parquet table in the shared folder and read it back."""
    ship(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/corpuslake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that written() made, when all that was read from them has been written itself."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(_paths.pop(df))
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def hinted(df: DataFrame, row_bytes: int = 16) -> DataFrame:
    """df, to be broadcast if it is counted as SMALL_ROWS rows of row_bytes at most; else Spark joins by a shuffle."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS * 16 // row_bytes else df


def fresh(name: str, *frames: DataFrame) -> str:
    """name, lengthened until no column of the frames is called so (names match in any case)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only doc_id and text (null text: empty), whatever else docs carries."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def ascii_lower(c):
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its rows, without copying; null is empty."""
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_blocks(batch: pa.RecordBatch, column: str = "text", most: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about `most` bytes (a longer row is a run of its own): first row, bytes, offsets."""
    if not batch.num_rows:
        return
    data, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        end = min(end, batch.num_rows)
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(WHITE_SPACE)] = True

ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (multiply, shift, xor)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * ODD)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD**i and its inverse modulo 2**64, for i < n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK_BYTES + 1)
        inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
        for name, base in (("up", ODD), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def starts_of(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First positions of the runs of True; a run ends where a row does."""
    before = np.empty(len(mask), bool)
    before[:1] = False
    before[1:] = mask[:-1]
    before[offsets[:-1][offsets[:-1] < len(mask)]] = False
    return np.flatnonzero(mask & ~before)


def word_hashes(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = IS_SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of bytes that are no separators) of each row, in order, and the n + 1 offsets of the rows in them."""
    low = LOWER[data] if lower else data
    inside = ~separator[low]
    starts = starts_of(inside, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    up, down = powers(len(low))
    codes = BYTE_CODES[low]
    codes *= up
    codes[~inside] = 0
    return mix(np.add.reduceat(codes, starts) * down[starts]), np.searchsorted(starts, offsets)


def sliding(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive entries of words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += words[i : len(words) - n + 1 + i]
    return mix(out)


def bloom_words(df: DataFrame, key: str, most: int = 21) -> np.ndarray:
    """A filter of 64-bit words over the long column key: about a word for every four keys, and 2**most words (16 MB) at most, beyond which it lets
    more pass. It never drops a key."""
    log_words = min(most, max(10, (df.count() // 4).bit_length()))
    word = F.col(key).bitwiseAND(F.lit((1 << log_words) - 1))
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({key}, {log_words}) & 63 as int))")
    rows = df.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << log_words, np.uint64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def may_hold(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For uint64 keys: whether bloom_words() may have seen them."""
    log_words = np.uint64(len(words).bit_length() - 1)
    return (words[keys & np.uint64(len(words) - 1)] >> ((keys >> log_words) & np.uint64(63))) & np.uint64(1) == 1
