"""A chunk table that a stream of documents keeps up to date, each document's chunks replaced as a whole."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .streams import run_batches

BUCKETS = 32
ATTEMPTS = 3


class ChunkTable:
    """Chunks and states of documents under a folder, by buckets of the key. A batch of new documents only is written as one more version of its buckets; one
    that has a document again writes the buckets that it changes anew, as a version that takes the place of those before. The versions are then named in the folder
    `heads`, as one file; so a batch that stopped midway, or comes again, changes nothing twice and loses nothing."""

    def __init__(self, spark: SparkSession, folder: str, key: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.key, self.buckets = spark, folder, key, buckets

    def versions(self) -> dict[int, list[int]]:
        """The versions of each bucket that hold, in order: the last that took the place of others, and those added since."""
        try:
            rows = self.spark.read.schema("bucket int, version long, added boolean").parquet(f"{self.folder}/heads")
        except AnalysisException:  # nothing is there yet
            return {}
        last = F.coalesce(F.max(F.when(~F.coalesce("added", F.lit(False)), F.col("version"))).over(Window.partitionBy("bucket")), F.lit(-1))
        held: dict[int, list[int]] = {}
        for r in rows.distinct().withColumn("last", last).where("version >= last").orderBy("version").collect():
            held.setdefault(r.bucket, []).append(r.version)
        return held

    def heads(self) -> dict[int, int]:
        """The latest version of each bucket."""
        return {b: vs[-1] for b, vs in self.versions().items()}

    def read(self, kind: str, buckets: list[int] | None = None) -> DataFrame | None:
        """chunks or states, as of now; of some buckets."""
        held: dict[int, list[int]] = {}
        for b, vs in self.versions().items():
            for v in vs if buckets is None or b in buckets else ():
                held.setdefault(v, []).append(b)
        if not held:
            return None
        rows = self.spark.read.option("basePath", f"{self.folder}/{kind}").parquet(f"{self.folder}/{kind}")
        alike: dict[tuple[int, ...], list[int]] = {}  # versions by the buckets that hold them
        for v, bs in held.items():
            alike.setdefault(tuple(sorted(bs)), []).append(v)
        return rows.where(reduce(lambda a, b: a | b, [F.col("version").isin(vs) & F.col("bucket").isin(list(bs)) for bs, vs in alike.items()]))

    def chunks(self) -> DataFrame | None:
        rows = self.read("chunks")
        return rows and rows.drop("bucket", "version")

    def states(self) -> DataFrame | None:
        """key, status (indexed or error), n_chunks, attempts, batch of each document seen."""
        rows = self.read("states")
        return rows and rows.drop("bucket", "version")

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def put(self, docs: DataFrame, chunk: Callable[[DataFrame], DataFrame], version: int, latest: str | None = None) -> None:
        """Replace the chunks of docs (of several rows with one key, the one with the greatest `latest`) by those that chunk() makes of them, and their
        states: error where it makes none. Rows without a key are left out. An attempt counts up while a document keeps failing."""
        docs = docs.where(F.col(self.key).isNotNull())
        if latest:
            newest = Window.partitionBy(self.key).orderBy(F.desc(latest))
            docs = docs.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
        else:
            docs = docs.dropDuplicates([self.key])
        docs = docs.persist()
        try:
            touched = [r.bucket for r in docs.select(self._bucket().alias("bucket")).distinct().collect()]  # at most `buckets`
            heads = self.heads()
            if not touched or any(heads.get(b, -1) >= version for b in touched):
                return  # done before
            keys = docs.select(self.key)
            new = chunk(docs)
            old_chunks, old_states = self.read("chunks", touched), self.read("states", touched)
            added = old_states is not None and not old_states.select(self.key).join(keys, self.key, "left_semi").limit(1).collect()
            if added:  # no document is there yet
                old_chunks = old_states = None
            kept = new if old_chunks is None else old_chunks.drop("bucket", "version").join(keys, self.key, "left_anti").unionByName(new, allowMissingColumns=True)
            self._write(kept, "chunks", version)
            made = self.spark.read.parquet(f"{self.folder}/chunks/version={version}").groupBy(self.key).agg(F.count("*").alias("n_chunks"))
            states = keys.join(made, self.key, "left").select(self.key, F.when(F.col("n_chunks") > 0, "indexed").otherwise("error").alias("status"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))
            if old_states is None:
                states = states.withColumn("attempts", F.lit(1))
            else:
                before = old_states.select(self.key, F.when(F.col("status") == "error", F.col("attempts")).alias("_a"))
                states = states.join(before, self.key, "left").withColumn("attempts", F.coalesce("_a", F.lit(0)) + 1).drop("_a")
            states = states.withColumn("batch", F.lit(version).cast("long"))
            if old_states is not None:
                states = old_states.drop("bucket", "version").join(keys, self.key, "left_anti").unionByName(states)
            self._write(states, "states", version)
            self.spark.createDataFrame([(b, version, added) for b in sorted(touched)], "bucket int, version long, added boolean").coalesce(1).write.mode("append").parquet(f"{self.folder}/heads")
        finally:
            docs.unpersist()

    def _write(self, rows: DataFrame, kind: str, version: int) -> None:
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{kind}/version={version}")

    def vacuum(self) -> None:
        """Delete the versions of which no bucket holds any more. Not while others read."""
        held = {v for vs in self.versions().values() for v in vs}
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        for kind in ("chunks", "states"):
            root = path(f"{self.folder}/{kind}")
            files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for f in files.listStatus(root) if files.exists(root) else []:
                name = f.getPath().getName()
                if name.startswith("version=") and int(name.split("=")[1]) not in held:
                    files.delete(f.getPath(), True)

    def next_version(self) -> int:
        return max(self.heads().values(), default=-1) + 1


def ingest(stream: DataFrame, chunk: Callable[[DataFrame], DataFrame], table: ChunkTable, checkpoint: str, latest: str | None = None) -> None:
    """Put all that the stream has into the table and stop. Versions are the stream's batches, so a batch that comes again is known."""
    base = 2 * 10**9  # versions of retries lie below those of the next batch
    run_batches(stream, checkpoint, lambda df, i: table.put(df, chunk, (i + 1) * base, latest), "append")


def retry(table: ChunkTable, docs: DataFrame, chunk: Callable[[DataFrame], DataFrame], most: int = ATTEMPTS) -> int:
    """Try documents in error again, from docs as they are now, unless they were tried `most` times; returns how many."""
    states = table.states()
    if states is None:
        return 0
    failed = states.where((F.col("status") == "error") & (F.col("attempts") < most)).select(table.key)
    again = docs.join(failed, table.key, "left_semi")
    n = again.count()
    if n:
        table.put(again, chunk, table.next_version())
    return n
