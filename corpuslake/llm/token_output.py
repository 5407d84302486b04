"""Token ids as files: fixed-size blocks of ids, transposed into bit or byte planes, each plane compressed by zstandard, with a chunk index."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir, ship
from .common import id_and_text, tidy, written
from .packing import byte_alphabet, little

BLOCK_IDS, END_ID, LEVEL = 65_536, 0, 3
#: Entries of a generation of the caches; with some 180 bytes an entry and two generations of each, some 320 MB a worker at most.
CACHE_SEGMENTS, CACHE_WORDS = 600_000, 300_000
#: A space is no break for certain where white space or an unknown lead byte follows.
UNSURE = re.compile(rb" (?:[^!-~\xc3-\xe0\xe4-\xf4]|\Z)")
#: Nor is a line feed that other white space or an unknown lead byte follows.
UNSURE_LINE = re.compile(rb"\n[^ -~\xc3-\xe0\xe4-\xf4]")
#: Characters that all versions of Unicode class alike: printable ASCII, line feeds, and the letters of Latin-1.
PLAIN = re.compile(r"[\n -~À-ÖØ-öø-ÿ]+")
BLOCKS = "shard int, block int, first long, n_ids int, lead long, doc_ids array<long>, lengths array<int>, open boolean, plane_bytes array<int>, bits boolean, checksum long, planes binary"


class Seen(dict):
    """What was computed for a key, in two generations: a full one becomes the old one, and what is found there moves on, so common keys stay."""

    def __init__(self, compute: Callable, most: int):
        super().__init__()
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class ByteTokenizer:
    """Token ids of texts as little-endian uint32 bytes, segment by segment.

    The tokenizer's pattern always breaks before a space that a visible character follows, and before and after a line feed that no other white space
    than such a space follows, so a text's ids are those of its segments joined, and most segments were seen before. A text in which a space may not be a
    break is encoded whole."""

    def __init__(self, path: str, cache_segments: int = CACHE_SEGMENTS, cache_words: int = CACHE_WORDS):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.model = self.whole.model
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.alphabet = {ord(letter): mapped for letter, mapped in zip(map(chr, range(256)), byte_alphabet(), strict=True)}
        self.words = Seen(self._word, cache_words)
        self.segments = Seen(self._segment, cache_segments)

    def _word(self, word: str) -> bytes:
        return little([t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.alphabet))])

    def _segment(self, segment: bytes) -> bytes:
        text = segment.decode()
        if PLAIN.fullmatch(text):
            if text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
                return self.words[text]
            return b"".join(map(self.words.__getitem__, self.pieces(text)))
        return little(self.whole.encode(text, add_special_tokens=False).ids)

    def ids(self, text: bytes) -> bytes:
        if UNSURE.search(text):
            return little(self.whole.encode(text.decode(), add_special_tokens=False).ids)
        if not UNSURE_LINE.search(text):
            text = text.replace(b"\n", b"\xff\n\xff")
        return b"".join(map(self.segments.__getitem__, text.replace(b" ", b"\xff ").split(b"\xff")))


_tokenizers: dict[str, ByteTokenizer] = {}


def tokenizer_for(path: str) -> ByteTokenizer:
    """One a worker process: what it has seen serves its later tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = ByteTokenizer(path)
    return _tokenizers[path]


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Planes of uint32 ids, lowest first: plane k holds byte k (or bit k, eight ids a byte) of every id. Planes above the highest set one are left out."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max()).bit_length() if len(ids) else 0
    if bits:
        flat = np.unpackbits(raw, axis=1, bitorder="little")
        return [np.packbits(flat[:, k], bitorder="little").tobytes() for k in range(top)]
    return [raw[:, k].tobytes() for k in range(-(-top // 8))]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    """The n ids of to_planes()."""
    if bits:
        flat = np.zeros((n, 32), np.uint8)
        for k, plane in enumerate(planes):
            flat[:, k] = np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little")
        raw = np.packbits(flat, axis=1, bitorder="little")
    else:
        raw = np.zeros((n, 4), np.uint8)
        for k, plane in enumerate(planes):
            raw[:, k] = np.frombuffer(plane, np.uint8)
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


def _shift(crc: int, n: int) -> int:
    """The crc register after n zero bytes: crc times x**(8 n) modulo the polynomial (bits reflected)."""

    def times(a: int, b: int) -> int:
        out = 0
        while b:
            if b & 0x80000000:
                out ^= a
            a = a >> 1 ^ (0xEDB88320 if a & 1 else 0)
            b = b << 1 & 0xFFFFFFFF
        return out

    power = 0x00800000  # x**8
    while n:
        if n & 1:
            crc = times(crc, power)
        power = times(power, power)
        n >>= 1
    return crc


def joined_crc(a: int, b: int, n: int) -> int:
    """The crc32 of two byte strings joined, from theirs and the length of the second."""
    return _shift(a, n) ^ b


def _blocks(path: str, block_ids: int, end_id: int, bits: bool, level: int) -> Callable:
    """The blocks of a task's documents, in their order. A block row also tells which documents its ids belong to: doc_ids and lengths of its pieces,
    how many ids of the first one lie in blocks before (lead), and whether the last one goes on in the next (open)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tokenizer, press = TaskContext.get().partitionId(), tokenizer_for(path), zstandard.ZstdCompressor(level=level)
        end = little([end_id])
        held, pieces, size, block, first, lead = [], [], 0, 0, 0, 0

        def flushed(open_: bool) -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            planes = [press.compress(p) for p in to_planes(ids, bits)]
            row = {"shard": shard, "block": block, "first": first, "n_ids": len(ids), "lead": lead, "doc_ids": [i for i, _ in pieces], "lengths": [n for _, n in pieces], "open": open_, "plane_bytes": list(map(len, planes)), "bits": bits, "checksum": zlib.crc32(ids.tobytes()), "planes": b"".join(planes)}
            return pa.RecordBatch.from_pylist([row], SCHEMA)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                coded, at = memoryview(tokenizer.ids(text.as_py()) + end), 0
                total = len(coded) // 4
                while at < total:
                    if size == block_ids:
                        yield flushed(at > 0)
                        held, pieces, block, first, size, lead = [], [], block + 1, first + size, 0, at
                    n = min(total - at, block_ids - size)
                    held.append(coded[4 * at : 4 * (at + n)])
                    pieces.append((doc_id, n))
                    at, size = at + n, size + n
        if size:
            yield flushed(False)

    return tidy(run)


SCHEMA = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("lead", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("open", pa.bool_()), ("plane_bytes", pa.list_(pa.int32())), ("bits", pa.bool_()), ("checksum", pa.int64()), ("planes", pa.binary())])


class TokenFiles(NamedTuple):
    """Where write_token_ids() put a corpus: the folder of the blocks and that of the chunk index."""

    blocks: str
    index: str


def write_token_ids(docs: DataFrame, tokenizer_path: str, folder: str | None = None, block_ids: int = BLOCK_IDS, end_id: int = END_ID, bits: bool = False, level: int = LEVEL) -> TokenFiles:
    """Write the token ids of docs, in ascending order of doc_id, each document followed by end_id, as blocks under folder (default: a new one in the
    shared folder), and the chunk index beside them.

    A null text is empty, so its document is end_id alone; a null doc_id comes first; rows of one doc_id stand in the order of their texts' hashes, then
    texts (rows repeated with both are alike); an empty table gives empty files; columns besides doc_id and text are not read. Of a long text only its own
    ids are held at once beside one block.

    Documents are dealt by ranges of (doc_id, hash), so file k of the blocks holds shard k, and shards follow one another. A shard's ids are cut into blocks of block_ids
    (its last block is shorter); a block's ids, 32-bit, are transposed into byte planes, or bit planes if bits, planes that are 0 throughout are left
    out, and each other plane is a zstandard frame of its own; plane_bytes are their lengths in planes, checksum the crc32 of the ids. The files are Parquet
    without further compression. The chunk index has a row for each block: shard, block, start (ids of the whole corpus before it), n_ids, bytes, and its
    first and last doc_id; read_range() finds blocks by it.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/corpuslake/token-ids-{uuid.uuid4().hex}"
    files = TokenFiles(f"{folder}/blocks", f"{folder}/index")
    order = ["doc_id", "hash", "text"]
    dealt = id_and_text(docs).withColumn("hash", F.xxhash64("text")).repartitionByRange("doc_id", "hash").sortWithinPartitions(*order)
    dealt.select("doc_id", "text").mapInArrow(_blocks(tokenizer_path, block_ids, end_id, bits, level), BLOCKS).write.option("compression", "uncompressed").parquet(files.blocks)
    blocks = spark.read.schema(BLOCKS).parquet(files.blocks)
    bounds = blocks.select("shard", "block", (F.col("first") + F.col("n_ids")).alias("end"), "first", "n_ids", F.aggregate("plane_bytes", F.lit(0), lambda a, x: a + x).alias("bytes"), F.element_at("doc_ids", 1).alias("first_doc"), F.element_at("doc_ids", -1).alias("last_doc"))
    # a shard's total is one row a task, so one window over them is small
    base = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = bounds.groupBy("shard").agg(F.max("end").alias("ids")).select("shard", base.alias("base"))
    bounds.join(F.broadcast(bases), "shard").select("shard", "block", (F.col("base") + F.col("first")).alias("start"), "n_ids", "bytes", "first_doc", "last_doc").write.parquet(files.index)
    return files


def chunk_index(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """shard, block, start, n_ids, bytes, first_doc, last_doc of each block."""
    return spark.read.schema("shard int, block int, start long, n_ids int, bytes int, first_doc long, last_doc long").parquet(files.index)


def _decoded(batch: pa.RecordBatch) -> Iterator[tuple[dict, np.ndarray]]:
    """The block rows of a batch and their ids, checked."""
    unpress = zstandard.ZstdDecompressor()
    for row in batch.to_pylist():
        planes, at = [], 0
        for n in row["plane_bytes"]:
            planes.append(unpress.decompress(row["planes"][at : at + n]))
            at += n
        ids = from_planes(planes, row["n_ids"], row["bits"])
        if zlib.crc32(ids.tobytes()) != row["checksum"]:
            raise ValueError(f"block {row['block']} of shard {row['shard']} is damaged")
        yield row, ids


PIECES = "doc_id long, start long, at long, n long, whole boolean, ids_crc32 long"


def _pieces(with_ids: bool) -> Callable:
    """The pieces of documents in the blocks: the document's start in the corpus, where in the document the piece begins, its length, and its ids or their crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, ids in _decoded(batch):
                rows: tuple[list, ...] = ([], [], [], [], [], [])
                at, last = 0, len(row["lengths"]) - 1
                for k, (doc_id, n) in enumerate(zip(row["doc_ids"], row["lengths"], strict=True)):
                    before = row["lead"] if k == 0 else 0
                    piece = ids[at : at + n]
                    values = (doc_id, row["start"] + at - before, before, n, before == 0 and not (k == last and row["open"]), piece if with_ids else zlib.crc32(piece.tobytes()))
                    for column, value in zip(rows, values, strict=True):
                        column.append(value)
                    at += n
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32()) if with_ids else pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["doc_id", "start", "at", "n", "whole", "ids" if with_ids else "ids_crc32"])

    return tidy(run)


def _placed(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """The blocks with their start in the corpus; shards' bases are one row a file."""
    bases = chunk_index(spark, files).where("block = 0").select("shard", F.col("start").alias("base"))
    blocks = spark.read.schema(BLOCKS).parquet(files.blocks)
    return blocks.join(F.broadcast(bases), "shard").withColumn("start", F.col("base") + F.col("first"))


def read_pieces(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """doc_id, start, at, n, whole, ids: the ids of each document from the files, a row for each block that it lies in (whole: all in this one)."""
    return _placed(spark, files).mapInArrow(_pieces(True), PIECES.replace("ids_crc32 long", "ids array<int>"))


def read_range(spark: SparkSession, files: TokenFiles, start: int, stop: int) -> DataFrame:
    """start, ids of the blocks' parts between two places of the corpus. The chunk index names the blocks; no other is read but for its file's footer."""
    wanted = chunk_index(spark, files).where((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start)).select("shard", "block", "start")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, ids in _decoded(batch):
                low, high = max(start - row["start"], 0), min(stop - row["start"], len(ids))
                yield pa.RecordBatch.from_arrays([pa.array([row["start"] + low]), pa.array([ids[low:high]], pa.list_(pa.int32()))], names=["start", "ids"])

    blocks = spark.read.schema(BLOCKS).parquet(files.blocks)
    edges = wanted.agg(F.min("shard").alias("low"), F.max("shard").alias("high")).first()
    if edges.low is None:
        return spark.createDataFrame([], "start long, ids array<int>")
    return blocks.where(F.col("shard").between(edges.low, edges.high)).join(wanted, ["shard", "block"]).mapInArrow(cut, "start long, ids array<int>")


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            crc, n = 0, 0
            for piece in row["pieces"]:
                crc, n = joined_crc(crc, piece["ids_crc32"], 4 * piece["n"]), n + piece["n"]
            rows.append((row["doc_id"], row["start"], n, crc))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.nulls(0, pa.int64())] * 4, names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_checksums(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files.

    A document inside one block is done where its block is read; of one that goes on, only the crc32 of its pieces is shuffled, by its place in the
    corpus, and joined there. Blocks are read once: what they say of their documents is written."""
    pieces = written(_placed(spark, files).mapInArrow(_pieces(False), PIECES), "pieces")
    whole = pieces.where("whole").select("doc_id", "start", F.col("n").alias("n_tokens"), "ids_crc32")
    parts = pieces.where("not whole").groupBy("doc_id", "start").agg(F.sort_array(F.collect_list(F.struct("at", "n", "ids_crc32"))).alias("pieces"))
    return whole.unionByName(parts.mapInArrow(_combined, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def token_output_query(docs: DataFrame) -> DataFrame:
    """All documents written, and read back from the files, which are then deleted; what was read stays as a small table."""
    import public_tokenizers

    spark = docs.sparkSession
    ship(spark)
    files = write_token_ids(docs, public_tokenizers.path("byte_bpe_50k.json"))
    out = written(token_checksums(spark, files), "tokens-read")
    drop_files(spark, files)
    return out


def drop_files(spark: SparkSession, files: TokenFiles) -> None:
    for folder in files:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
