"""Vector search: a table of questions against an index of vectors, by blocked matrix products with bounded heaps.

Vectors that are null, zero or hold null or non-finite components, and those of another length than a question's, score nothing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir, ship

DENSE_K, THRESHOLD = 18, 0.65
#: Questions asked in one pass, and scores of a block of the product (16 MB).
PASS_QUESTIONS, BLOCK_SCORES = 8_192, 1 << 21
#: Statuses that are left out of searches; fixed values.
EXPIRED = ["Hết hiệu lực", "superseded", "repealed"]
#: The sample that cells are fitted on: so many vectors a cell, and so many cells at most. Scores by codes are within SLACK of exact ones.
SAMPLE_PER_CELL, MOST_CELLS, SLACK = 64, 1_024, 0.02


def payload_filter(index: DataFrame, status: str | None = None, expired: list[str] = EXPIRED, **equal) -> DataFrame:
    """Rows of an index whose payload has the values asked for (a value, or a list of which any fits; None asks for nothing) and, if status is given,
    whose status is not an expired one (a null status is not expired). They are plain conditions on columns, so they reach the scan."""
    for c, v in equal.items():
        if v is not None:
            index = index.where(F.col(c).isin(v) if isinstance(v, list) else F.col(c) == v)
    return index.where(F.col(status).isNull() | ~F.col(status).isin(expired)) if status else index


class Asked(NamedTuple):
    """Questions of one vector length: their keys, unit vectors as rows, distinct scopes, and which of them each question has."""

    keys: pa.Array
    unit: np.ndarray
    scopes: list[frozenset | None]
    scope: np.ndarray


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and unit vectors (doubles), for each length that vectors of the column have."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    for size in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == size)
        flat = column.take(pa.array(rows)).flatten().cast(pa.float64())
        v = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(rows), size)
        largest = np.abs(v).max(1)
        fine = np.isfinite(largest) & (largest > 0)  # NaN is not finite
        v = v[fine] / largest[fine, None]
        yield rows[fine], v / np.sqrt((v * v).sum(1))[:, None]


def asked_of(table: pa.Table, key: str, vector: str, scope: str | None) -> list[Asked]:
    sets = [None if s is None else frozenset(s) for s in (table[scope].to_pylist() if scope else [None] * table.num_rows)]
    out = []
    for rows, unit in matrices(table[vector]):
        if not len(rows):
            continue
        scopes = list(dict.fromkeys(sets[r] for r in rows))
        numbers = {s: i for i, s in enumerate(scopes)}
        out.append(Asked(table[key].combine_chunks().take(pa.array(rows)), unit, scopes, np.array([numbers[sets[r]] for r in rows], np.int64)))
    return out


def rounded(x: np.ndarray) -> np.ndarray:
    """Six decimals, halves upwards."""
    return np.floor(x * 1e6 + 0.5) / 1e6


class Heaps:
    """The best k (score, then smallest key) of each question, of all that was added; memory is bounded by the questions, k and one block."""

    def __init__(self, n: int, k: int | None, threshold: float):
        self.k, self.bar, self.held, self.size = k, np.full(n, threshold), [], 0

    def add(self, questions: np.ndarray, scores: np.ndarray, keys: pa.Array) -> None:
        q, row = np.nonzero(scores >= self.bar[questions][:, None])
        if len(q):
            self.held.append(pa.table({"q": pa.array(questions[q]), "score": pa.array(scores[q, row]), "key": keys.take(pa.array(row))}))
            self.size += len(q)

    def crowded(self) -> bool:
        return self.size > 4 * len(self.bar) * (self.k or 8) + (1 << 16)

    def settle(self) -> pa.Table | None:
        """What is held; with k, only the best of it stays, and what comes must reach the worst of them."""
        if not self.held:
            return None
        rows = pa.concat_tables(self.held)
        if self.k:
            rows = rows.sort_by([("q", "ascending"), ("score", "descending"), ("key", "ascending")]).combine_chunks()
            q = rows["q"].to_numpy()
            first = np.searchsorted(q, q)
            rows = rows.filter(pa.array(np.arange(len(q)) - first < self.k))
            q, score = rows["q"].to_numpy(), rows["score"].to_numpy()
            full = np.flatnonzero(np.bincount(q, minlength=len(self.bar)) >= self.k)
            self.bar[full] = score[np.searchsorted(q, full, "right") - 1]
        self.held, self.size = [rows], rows.num_rows
        return rows


def _scored(asked: list[Asked], names: tuple[str, str], k: int | None, threshold: float, unpack: Callable, group: bool, digits: bool = True) -> Callable:
    """(question, key, score) of a task's part of the index: columns key, then what unpack reads, then the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = [Heaps(len(a.unit), k, threshold) for a in asked]

        def flushed(a: Asked, rows: pa.Table) -> Iterator[pa.RecordBatch]:
            out = pa.table([a.keys.take(rows["q"].combine_chunks()), rows["key"], rows["score"]], names=[*names, "score"])
            yield from out.to_batches(max_chunksize=1 << 16)

        for batch in batches:
            keys, groups = batch.column(0), batch.column(batch.num_columns - 1) if group else None
            coded = groups.dictionary_encode() if group else None
            for size, rows, unit, parts in unpack(batch):
                for a, heap in zip(asked, heaps, strict=True):
                    if a.unit.shape[1] != size:
                        continue
                    fits = None
                    if group and a.scopes != [None]:
                        names_ = coded.dictionary.to_pylist()
                        code = coded.indices.fill_null(len(names_)).to_numpy(zero_copy_only=False)[rows]
                        fits = np.array([[s is None or x in s for x in names_] + [s is None] for s in a.scopes])[:, code]
                    for some, questions in parts(a):
                        step = max(1, BLOCK_SCORES // max(1, len(questions)))
                        for at in range(0, len(some), step):
                            part = some[at : at + step]
                            scores = a.unit[questions] @ unit[part].T
                            scores = rounded(scores) if digits else scores
                            if fits is not None:
                                scores[~fits[a.scope[questions]][:, part]] = -np.inf
                            heap.add(questions, scores, keys.take(pa.array(rows[part])))
                            if heap.crowded():
                                settled = heap.settle()
                                if not k:
                                    yield from flushed(a, settled)
                                    heap.held, heap.size = [], 0
        for a, heap in zip(asked, heaps, strict=True):
            if (settled := heap.settle()) is not None:
                yield from flushed(a, settled)

    return run


def _plain(batch: pa.RecordBatch) -> Iterator:
    for rows, unit in matrices(batch.column(1)):
        yield unit.shape[1], rows, unit, lambda a, n=len(rows): [(np.arange(n), np.arange(len(a.unit)))]


def passes_for(questions: DataFrame) -> int:
    """Passes in which the questions, a stated query set, are asked: one, or so many that a pass has about half of PASS_QUESTIONS."""
    n = -(-questions.count() // PASS_QUESTIONS)
    return n if n < 2 else 2 * n


def question_passes(questions: DataFrame, passes: int, key: str, vector: str, scope: str | None = None) -> Iterator[list[Asked]]:
    """The questions of each pass."""
    columns = [c for c in (key, vector, scope) if c]
    for i in range(max(1, passes)):
        some = questions.where(F.pmod(F.xxhash64(key), F.lit(passes)) == i) if passes > 1 else questions
        yield asked_of(some.select(*columns).toArrow(), key, vector, scope)


def _one_by_one(parts: Iterator[DataFrame], several: bool) -> DataFrame:
    """The parts of several passes are written one after the other, so that no plan holds all questions."""
    if not several:
        return next(parts)
    folder, schema = None, None
    for part in parts:
        folder = folder or f"{shared_dir(part.sparkSession)}/corpuslake/passes-{uuid.uuid4().hex}"
        part.write.mode("append").parquet(folder)
        schema, spark = part.schema, part.sparkSession
    return spark.read.schema(schema).parquet(folder)


def _result(questions: DataFrame, question_key: str, index: DataFrame, key: str) -> T.StructType:
    return T.StructType([T.StructField(question_key, questions.schema[question_key].dataType), T.StructField(key, index.schema[key].dataType), T.StructField("score", T.DoubleType())])


def dense_hits(questions: DataFrame, index: DataFrame, question_key: str, key: str, vector: str, threshold: float = THRESHOLD, k: int | None = None, scope: str | None = None, group: str | None = None) -> DataFrame:
    """question_key, key, score (cosine, six decimals): the vectors of the index that reach the threshold; with k, a task keeps only the k best of each
    question, of which the best k of all are to be taken.

    scope: a column of questions with the values of the index's column group that a question looks at (null: all). The index is read once for each
    pass of questions, and not shuffled; no row is made for a pair below the threshold."""
    spark = index.sparkSession
    ship(spark)
    schema = _result(questions, question_key, index, key)
    columns, passes = index.select(key, vector, *([group] if scope else [])), passes_for(questions)
    parts = (columns.mapInArrow(_scored(asked, (question_key, key), k, threshold, _plain, bool(scope)), schema) for asked in question_passes(questions, passes, question_key, vector, scope))
    return _one_by_one(parts, passes > 1)


def best(hits: DataFrame, question_key: str, key: str, k: int, score: str = "score", rank: str = "rank") -> DataFrame:
    w = Window.partitionBy(question_key).orderBy(F.desc(score), key)
    return hits.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def dense_topk(questions: DataFrame, index: DataFrame, question_key: str, key: str, vector: str, k: int = DENSE_K, threshold: float = THRESHOLD, scope: str | None = None, group: str | None = None) -> DataFrame:
    """question_key, key, score, rank: the k best vectors by cosine from the threshold on; ties go by key. See dense_hits() for scope and group, and
    payload_filter() for conditions that hold for all questions."""
    return best(dense_hits(questions, index, question_key, key, vector, threshold, k, scope, group), question_key, key, k)


class VectorIndex(NamedTuple):
    """A written index: coarse cells with their centre and radius, and each vector's residual as one byte a component."""

    codes: str
    cells: str
    key: str
    group: str | None


def drop_vector_index(spark: SparkSession, files: VectorIndex) -> None:
    for folder in (files.codes, files.cells):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fitted_cells(sample: np.ndarray, n: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Centres (unit vectors) of n cells: spherical k-means."""
    pick = np.random.default_rng(seed)
    centres = sample[pick.choice(len(sample), min(n, len(sample)), replace=False)]
    for _ in range(rounds):
        cell = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, sample)
        norms = np.sqrt((sums * sums).sum(1))
        centres = np.where(norms[:, None] > 0, sums / np.where(norms > 0, norms, 1)[:, None], centres)
    return centres


def _encoded(centres: dict[int, np.ndarray], group: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, unit in matrices(batch.column(1)):
                size = unit.shape[1]
                near = unit @ centres[size].T if size in centres else np.zeros((len(rows), 1))
                cell = near.argmax(1)
                rest = unit - (centres[size][cell] if size in centres else 0)
                scale = np.maximum(np.abs(rest).max(1), 1e-12) / 127
                code = np.rint(rest / scale[:, None]).astype(np.int8)
                flat = pa.array([c.tobytes() for c in code], pa.binary())
                columns = [batch.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), size, np.int32)), pa.array(cell.astype(np.int32)), pa.array(near[np.arange(len(rows)), cell]), pa.array(scale), flat]
                names = ["key", "size", "cell", "near", "scale", "code"]
                if group:
                    columns.append(batch.column(2).take(pa.array(rows)))
                    names.append("group")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def write_vector_index(index: DataFrame, key: str, vector: str, group: str | None = None, cells: int | None = None, folder: str | None = None) -> VectorIndex:
    """Write the codes of index's vectors in the order of their cells, so that a reader of few cells skips the rest, and the cells.

    cells (default: the root of the count, MOST_CELLS at most) are fitted, for the commonest vector length, on a sample of SAMPLE_PER_CELL vectors a cell; every
    vector is indexed. Vectors of other lengths have one cell without a centre."""
    spark = index.sparkSession
    ship(spark)
    folder = folder or f"{shared_dir(spark)}/corpuslake/vectors-{uuid.uuid4().hex}"
    lengths = index.where(F.size(vector) > 0).groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), "size").first()
    centres: dict[int, np.ndarray] = {}
    if lengths:
        n = min(MOST_CELLS, cells or max(1, round(lengths["count"] ** 0.5)))
        held = index.where(F.size(vector) == lengths["size"]).select(vector)
        share = min(1.0, 1.5 * SAMPLE_PER_CELL * n / lengths["count"])
        taken = (held.sample(share, 7) if share < 1 else held).limit(SAMPLE_PER_CELL * n).toArrow()
        found = [unit for _, unit in matrices(taken[vector])]
        if found:
            centres[lengths["size"]] = fitted_cells(found[0], n)
    fields = f"key {index.schema[key].dataType.simpleString()}, size int, cell int, near double, scale double, code binary" + (f", `group` {index.schema[group].dataType.simpleString()}" if group else "")
    codes = index.select(key, vector, *([group] if group else [])).mapInArrow(_encoded(centres, bool(group)), fields)
    codes.repartitionByRange("size", "cell").sortWithinPartitions("size", "cell").write.parquet(f"{folder}/codes")
    rows = [(int(s), i, c.tolist()) for s, m in centres.items() for i, c in enumerate(m)]
    centre = spark.createDataFrame(rows, "size int, cell int, centre array<double>")
    spread = spark.read.parquet(f"{folder}/codes").groupBy("size", "cell").agg(F.count("*").alias("n"), F.min("near").alias("least"))
    spread.join(centre, ["size", "cell"], "left").write.parquet(f"{folder}/cells")
    return VectorIndex(f"{folder}/codes", f"{folder}/cells", key, group)


def _probed(asked: list[Asked], cells: list, threshold: float, probes: float | None) -> tuple[list[np.ndarray], dict[int, dict[int, int]]]:
    """For each length: questions x cells, whether a question looks into a cell. Without probes, cells are left out only where no vector as near to
    the centre as theirs can reach the threshold; with probes, that share of the cells nearest to a question is kept of those."""
    looks, places = [], {}
    for a in asked:
        size = a.unit.shape[1]
        own = [c for c in cells if c.size == size]
        places[size] = {c.cell: i for i, c in enumerate(own)}
        if not own or own[0].centre is None:
            looks.append(np.ones((len(a.unit), len(own)), bool))
            continue
        near = a.unit @ np.array([c.centre for c in own]).T
        angle = np.arccos(np.clip(near, -1, 1)) - np.arccos(np.clip([c.least for c in own], -1, 1))[None, :]
        look = np.cos(np.maximum(angle, 0)) >= threshold - 1e-6
        if probes is not None and probes < 1:
            keep = max(1, int(np.ceil(probes * len(own))))
            order = np.argsort(-near, 1, kind="stable")[:, :keep]
            chosen = np.zeros_like(look)
            np.put_along_axis(chosen, order, True, 1)
            look &= chosen
        looks.append(look)
    return looks, places


def _lists(asked: list[Asked], looks: list[np.ndarray], places: dict, centres: dict) -> Callable:
    """Unpacks batches (key, size, cell, scale, code): runs of rows of one cell, with the questions that look into it."""
    by_size = {a.unit.shape[1]: look for a, look in zip(asked, looks, strict=True)}

    def unpack(batch: pa.RecordBatch) -> Iterator:
        sizes, cells = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
        scale = batch.column(3).to_numpy(zero_copy_only=False)
        for size in np.unique(sizes):
            if int(size) not in by_size:
                continue
            rows = np.flatnonzero(sizes == size)
            codes = np.frombuffer(b"".join(batch.column(4).take(pa.array(rows)).to_pylist()), np.int8).reshape(len(rows), size)
            unit = codes * scale[rows, None]
            if (centre := centres.get(int(size))) is not None:
                unit += centre[[places[int(size)][c] for c in cells[rows]]]
            edges = np.flatnonzero(np.r_[True, cells[rows][1:] != cells[rows][:-1]])
            runs = list(zip(edges, [*edges[1:], len(rows)], strict=True))

            def parts(_, runs=runs, rows=rows, look=by_size[int(size)], place=places[int(size)]):
                for low, high in runs:
                    questions = np.flatnonzero(look[:, place[int(cells[rows[low]])]])
                    if len(questions):
                        yield np.arange(low, high), questions

            yield int(size), rows, unit, parts

    return unpack


def dense_topk_index(spark: SparkSession, questions: DataFrame, files: VectorIndex, index: DataFrame, question_key: str, key: str, vector: str, k: int = DENSE_K, threshold: float = THRESHOLD, scope: str | None = None, probes: float | None = None, rescore: int = 4) -> DataFrame:
    """dense_topk() by a written index: question_key, key, score, rank.

    A question looks into the cells that can hold a vector within the threshold (probes: of these, only the given share of all cells nearest to it). The codes
    of those cells give scores within SLACK of exact ones; the best rescore * k of a question are scored again by their vectors, read by a join on
    the key. Codes take one byte a component, and cells that no question looks into are not read."""
    ship(spark)
    cells = spark.read.parquet(files.cells).orderBy("size", "cell").collect()  # MOST_CELLS at most, and one for each other length
    codes = spark.read.parquet(files.codes)
    schema = T.StructType([T.StructField(question_key, questions.schema[question_key].dataType), T.StructField("key", codes.schema["key"].dataType), T.StructField("score", T.DoubleType())])
    passes = passes_for(questions)

    def parts() -> Iterator[DataFrame]:
        for asked in question_passes(questions, passes, question_key, vector, scope):
            looks, places = _probed(asked, cells, threshold, probes)
            centres = {s: np.array([c.centre for c in cells if c.size == s]) for s in places if any(c.size == s and c.centre is not None for c in cells)}
            wanted = F.lit(False)
            for a, look in zip(asked, looks, strict=True):
                size = a.unit.shape[1]
                some = [c for c, i in places[size].items() if look[:, i].any()]
                whole = F.col("size") == size
                wanted = wanted | (whole if len(some) == len(places[size]) else whole & F.col("cell").isin(some))
            rows = codes.where(wanted).select("key", "size", "cell", "scale", "code", *(["group"] if scope else []))
            yield rows.mapInArrow(_scored(asked, (question_key, "key"), rescore * k, threshold - SLACK, _lists(asked, looks, places, centres), bool(scope), digits=False), schema)

    found = _one_by_one(parts(), passes > 1)
    near = best(found, question_key, "key", rescore * k).select(question_key, F.col("key").alias(key))
    held, asked_ = index.select(key, F.col(vector).cast("array<double>").alias("_v")), questions.select(question_key, F.col(vector).cast("array<double>").alias("_q"))
    largest = lambda c: F.array_max(F.transform(c, F.abs))
    vectors = near.join(held, key).join(asked_, question_key).withColumn("_a", largest("_q")).withColumn("_b", largest("_v"))
    # scaled, so that squares of large components stay finite
    vectors = vectors.withColumn("_q", F.transform("_q", lambda x: x / F.col("_a"))).withColumn("_v", F.transform("_v", lambda x: x / F.col("_b")))
    product = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    exact = F.round(product("_q", "_v") / F.sqrt(product("_q", "_q") * product("_v", "_v")), 6)
    return best(vectors.select(question_key, key, exact.alias("score")).where(F.col("score") >= threshold), question_key, key, k)


def pairs_looked_at(spark: SparkSession, questions: DataFrame, files: VectorIndex, question_key: str, vector: str, threshold: float = THRESHOLD, probes: float | None = None) -> float:
    """The share of all pairs of a question and a vector whose codes dense_topk_index() compares."""
    cells = spark.read.parquet(files.cells).orderBy("size", "cell").collect()
    seen = every = 0
    for asked in question_passes(questions, passes_for(questions), question_key, vector):
        looks, places = _probed(asked, cells, threshold, probes)
        for a, look in zip(asked, looks, strict=True):
            n = np.array([c.n for c in cells if c.size == a.unit.shape[1]])
            seen += int((look * n).sum())
            every += len(a.unit) * int(n.sum())
    return seen / every if every else 0.0
