"""Near-duplicate embeddings: an epsilon grid order join."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .components import connected_components, smallest_reachable

COSINE, BLOCK, LEAF, COLUMNS, GRID_DIMENSIONS, BOX_DIMENSIONS, INTERVALS, INTERVAL_BLOCKS = 0.95, 16384, 256, 4096, 8, 16, 512, 16
#: Bounds: of a block's bytes, of the intervals (beyond it they hold more blocks each), and of the components that axes are looked for in.
BLOCK_BYTES, MOST_INTERVALS, AXIS_COMPONENTS = 32 << 20, 1 << 15, 512
#: Blocks are dealt into TILES tiles, more if one held over TILE_BYTES; a task joins two tiles.
TILES, TILE_BYTES = 32, 64 << 20
#: BORDER: how near to the bound a product is summed anew. SLACK: what squared distances in single precision on BOX_DIMENSIONS axes may err by, and more. A step takes FACTOR_BYTES of vectors.
BORDER, SLACK, FACTOR_BYTES = 1e-9, 2e-5, 16 << 20


def _valid(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector in double precision, or None if it is null, empty, zero, or holds null or non-finite components."""
    out: list[np.ndarray | None] = []
    for x in column:
        v = None if x.as_py() is None or x.values.null_count else x.values.to_numpy(zero_copy_only=False).astype(np.float64)
        out.append(v if v is not None and len(v) and np.isfinite(v).all() and v.any() else None)
    return out


def _key(v: np.ndarray) -> str:
    """128 bits in hex that tell vectors apart; -0 is 0."""
    return hashlib.blake2b((v + 0.0).tobytes(), digest_size=16).hexdigest()


def _keys() -> Callable:
    """(vec_id, key, n): key tells equal vectors (null: links with nothing); n is the number of components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _valid(batch.column(1))
            keys = [None if v is None else _key(v) for v in vectors]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string()), pa.array([0 if v is None else len(v) for v in vectors], pa.int32())], names=["vec_id", "key", "n"])

    return run


def _unit(v: np.ndarray) -> np.ndarray:
    scaled = v / np.abs(v).max()
    return scaled / np.linalg.norm(scaled)


def _padded(vectors: list[np.ndarray], components: int) -> np.ndarray:
    """The first components of each vector, shorter ones padded with zeros."""
    out = np.zeros((len(vectors), components))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v[:components]
    return out


def _moments(components: int) -> Callable:
    """Sums of x x^T over the first components of the task's unit vectors, a row for each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((components, components))
        for batch in batches:
            if vectors := [_unit(v) for v in _valid(batch.column(1)) if v is not None]:
                u = _padded(vectors, components)
                total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "s"])

    return run


def principal_axes(vectors: DataFrame, components: int) -> np.ndarray:
    """Orthonormal columns, leading directions of all unit vectors' first components first; the driver sees components ** 2 sums, AXIS_COMPONENTS ** 2 at
    most. On axes of some components only, distances are no greater than the vectors' own, so what they prove distant is."""
    rows = vectors.mapInArrow(_moments(components), "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    moment = np.zeros(components * components)
    for r in rows:
        moment[r.i] = r.s
    return np.linalg.eigh(moment.reshape(components, components))[1][:, ::-1].copy()


def _as_lists(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel(), kind))


def _celled(axes: np.ndarray, epsilon: float) -> Callable:
    """(key, n, cell, lead, vector) of valid vectors: the number of components, the grid cell on the leading axes, the unit vector's place on more of them,
    and the unit vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [v for v in _valid(batch.column(1)) if v is not None]
            unit = [_unit(v) for v in vectors]
            lead = _padded(unit, len(axes)) @ axes[:, :BOX_DIMENSIONS]
            cells = np.floor(lead[:, :GRID_DIMENSIONS] / epsilon).astype(np.int32)
            columns = [pa.array([_key(v) for v in vectors], pa.string()), pa.array([len(v) for v in vectors], pa.int32()), _as_lists(cells, pa.int32()), _as_lists(lead, pa.float64()), pa.array(unit, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n", "cell", "lead", "vector"])

    return run


def _blocks(lead_width: int) -> Callable:
    """Runs of vectors of one length in epsilon grid order, BLOCK at most and within BLOCK_BYTES, each with the box around it on the leading axes.
    Columns: node, copies, n, lead, vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        rows, width = 0, 0

        def most() -> int:
            return max(16, min(BLOCK, BLOCK_BYTES // (8 * width)))

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            nodes, copies = (t[c].to_numpy() for c in ("node", "copies"))
            x = t["lead"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, lead_width)
            y = t["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            data = [np.ascontiguousarray(z).tobytes() for z in (nodes, copies, x, y)]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([(part << 32) + made], pa.int64()), pa.array([x.min(0).tolist()]), pa.array([x.max(0).tolist()]), *(pa.array([d]) for d in data)], names=["part", "block", "low", "high", "nodes", "copies", "lead", "data"])

        for batch in batches:
            n = batch.column(2).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(n[1:] != n[:-1]) + 1), len(n)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                while a < b:
                    if rows and (width != n[a] or rows == most()):
                        yield block()
                        held, rows, made = [], 0, made + 1
                    width = int(n[a])
                    taken = min(b - a, most() - rows)
                    held.append(batch.slice(a, taken))
                    a, rows = a + taken, rows + taken
        if rows:
            yield block()

    return run


def box_distance2(low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> np.ndarray:
    """Squared distance between boxes: no two points in them are nearer."""
    gap = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
    return (gap * gap).sum(-1)


def _leaves(lead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.arange(0, len(lead), LEAF)
    return np.minimum.reduceat(lead, cuts), np.maximum.reduceat(lead, cuts)


def join_intervals(a: np.ndarray, b: np.ndarray, lead_a: np.ndarray, lead_b: np.ndarray, same: bool, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a and b whose cosine reaches the bound (same: a is b, each pair once). LEAF rows of a at a time meet the leaves of b that boxes do not
    prove distant; there the leading axes alone rule out most pairs, in one product in single precision with room for its error, and the rest is computed
    whole in double precision. Within BORDER of the bound, products are summed anew in the order of the components, so that a pair is decided alike
    wherever it stands."""
    common = min(a.shape[1], b.shape[1])  # the shorter vectors are 0 beyond it
    a, b = (np.ascontiguousarray(x[:, :common]) for x in (a, b))
    epsilon2 = 2 - 2 * cosine + 1e-9
    (low_a, high_a), (low_b, high_b) = _leaves(lead_a), _leaves(lead_b)
    near_leaves = box_distance2(low_a[:, None], high_a[:, None], low_b, high_b) <= epsilon2
    if same:
        near_leaves = np.triu(near_leaves)
    squares = lambda x: (x * x).sum(1)[:, None]
    p = np.hstack([-2 * lead_a, squares(lead_a), np.ones((len(a), 1))]).astype(np.float32)
    q = np.hstack([lead_b, np.ones((len(b), 1)), squares(lead_b)]).astype(np.float32)
    step = max(1, FACTOR_BYTES // (8 * common))
    for leaf in np.flatnonzero(near_leaves.any(1)):
        a0, whole = leaf * LEAF, near_leaves[leaf].all()
        rows, places = slice(a0, a0 + LEAF), np.arange(len(b)) if whole else np.flatnonzero(np.repeat(near_leaves[leaf], LEAF)[: len(b)])
        for b0 in range(0, len(places), COLUMNS):
            at = places[b0 : b0 + COLUMNS]
            columns = slice(b0, b0 + COLUMNS) if whole else at
            near = p[rows] @ q[columns].T <= np.float32(epsilon2 + SLACK)
            if same:
                near &= np.arange(a0, min(a0 + LEAF, len(a)))[:, None] < at
            found = np.flatnonzero(near)
            dense = (a[rows] @ b[columns].T).ravel() if len(found) * 4 > near.size else None
            for start in range(0, len(found), step):
                pairs = found[start : start + step]
                i, j = np.divmod(pairs, len(at))
                i, j = i + a0, at[j]
                c = np.einsum("ij,ij->i", a[i], b[j]) if dense is None else dense[pairs]
                edge = np.flatnonzero(np.abs(c - cosine) <= BORDER)
                c[edge] = np.add.accumulate(a[i[edge]] * b[j[edge]], axis=1)[:, -1]
                ok = c >= cosine
                if ok.any():
                    yield i[ok], j[ok]


def _joined(lead_width: int, cosine: float) -> Callable:
    """From pairs of blocks: (a, null, links) how many vectors each node links with, and (a, b, null) enough links to connect all
    that are connected within the pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                same = batch.column(0)[row].as_py() == batch.column(5)[row].as_py()
                ids, copies, leads, data = [], [], [], []
                for side in (0, 1):
                    for k, (held, kind) in enumerate(((ids, np.int64), (copies, np.int64), (leads, np.float64), (data, np.float64))):
                        held.append(np.frombuffer(batch.column(1 + 5 * side + k)[row].as_buffer(), kind))
                    leads[side], data[side] = leads[side].reshape(-1, lead_width), data[side].reshape(len(ids[side]), -1)
                links = [np.zeros(len(x), np.int64) for x in ids]
                edges = []
                for i, j in join_intervals(*data, *leads, same, cosine):
                    np.add.at(links[0], i, copies[1][j])
                    np.add.at(links[1], j, copies[0][i])
                    nodes, root = smallest_reachable(ids[0][i], ids[1][j])
                    edges.append((nodes[nodes != root], root[nodes != root]))
                if not edges:
                    continue
                u, v = (np.concatenate([e[k] for e in edges]) for k in (0, 1))
                nodes, root = smallest_reachable(u, v)
                u, v = nodes[nodes != root], root[nodes != root]
                rep, n = np.concatenate(ids), np.concatenate(links)
                rep, n = rep[n > 0], n[n > 0]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([rep, u])), pa.concat_arrays([pa.nulls(len(rep), pa.int64()), pa.array(v)]), pa.concat_arrays([pa.array(n), pa.nulls(len(u), pa.int64())])], names=["a", "b", "links"])

    return run


def near_block_pairs(blocks: DataFrame, epsilon: float, tiles: int) -> DataFrame:
    """The pairs x, y (x <= y) of blocks whose boxes are at most epsilon apart, with what both hold.

    Each task reads two tiles of the written blocks and pairs their rows where it holds them: no block is shuffled, however many it meets."""
    held = ("block", "low", "high", "nodes", "copies", "lead", "data")
    side = lambda s: blocks.coalesce(tiles).select(*(F.col(c).alias(f"{s}_{c}") for c in held))
    gap2 = F.expr("aggregate(zip_with(zip_with(x_low, y_high, (a, b) -> a - b), zip_with(y_low, x_high, (a, b) -> a - b), (a, b) -> greatest(a, b, 0D)), 0D, (s, g) -> s + g * g)")
    return side("x").hint("shuffle_replicate_nl").join(side("y"), (F.col("x_block") <= F.col("y_block")) & (gap2 <= epsilon * epsilon + 1e-9))


def near_duplicate_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding): vectors link when their cosine is at least the bound.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing. A shorter vector counts as padded
    with zeros. Equal vectors link with each other and are one node with a number of copies from there on, told by 128 bits of hash and numbered by 64.
    A row with a null vec_id is not compared (n_links 0, component_id null, kept true). Rows that share a vec_id count each in n_links, and each has
    the links of its own vector. A pair at the bound counts as linked, and is decided alike in any order of rows. An empty table gives no
    rows. Other columns are not read.

    Unit vectors are placed on the principal axes of all rows' first components (as many as the commonest length has, AXIS_COMPONENTS at most), which tell most. They are
    range-partitioned and sorted by their length and their grid cells of side epsilon = sqrt(2 - 2 cosine) on the leading axes, and cut into blocks with boxes.
    Pairs of blocks whose boxes are further apart than epsilon are skipped; a task reads two tiles of blocks, joins the blocks of one with those of the other,
    counts links and emits them as a forest, so no group is expanded into pairs of rows, and what is written grows with the rows, not with the pairs.
    """
    spark = vectors.sparkSession
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = written(source.mapInArrow(_keys(), "vec_id long, key string, n int"), "keys")
    node = F.expr("cast(conv(substring(key, 1, 16), 16, -10) as long)")
    groups = written(rows.where("vec_id is not null and key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("node", node), "nodes")
    commonest = rows.where("n > 0").groupBy("n").count().orderBy(F.desc("count"), "n").first()
    if commonest:
        epsilon = math.sqrt(2 - 2 * cosine)
        axes = principal_axes(source, min(commonest.n, AXIS_COMPONENTS))
        lead_width = min(BOX_DIMENSIONS, len(axes))
        placed = source.where("vec_id is not null").mapInArrow(_celled(axes, epsilon), "key string, n int, cell array<int>, lead array<double>, vector array<double>").dropDuplicates(["key"])
        celled = written(placed.join(groups, "key").select("node", "copies", "n", "cell", "lead", "vector"), "cells")
        n, components = celled.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        intervals = min(MOST_INTERVALS, max(1, min(INTERVALS, n // BLOCK), n // (BLOCK * INTERVAL_BLOCKS)))
        ordered = celled.repartitionByRange(intervals, "n", "cell", "node").sortWithinPartitions("n", "cell", "node").select("node", "copies", "n", "lead", "vector")
        if ordered.rdd.getNumPartitions() > intervals:  # neighbours are put together, or blocks would be small, and their pairs many
            ordered = ordered.coalesce(intervals)
        blocks = written(ordered.mapInArrow(_blocks(lead_width), "part long, block long, low array<double>, high array<double>, nodes binary, copies binary, lead binary, data binary"), "blocks")
        tiles = max(TILES, -(-8 * (components + n * lead_width) // TILE_BYTES))
        held = ("block", "nodes", "copies", "lead", "data")
        pairs = near_block_pairs(blocks, epsilon, tiles).select(*(f"{s}_{c}" for s in "xy" for c in held))
        found = written(pairs.mapInArrow(_joined(lead_width, cosine), "a long, b long, links long"), "links")
        discard(celled, blocks)
    else:
        found = spark.createDataFrame([], "a long, b long, links long")
    degrees = found.where("links is not null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    components = connected_components(found.where("b is not null").select("a", "b"))
    named = written(groups.join(degrees, "node", "left").join(components, "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    out = rows.join(named.join(smallest, "component").select("key", "copies", "links", "component_id"), "key", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    n_links = F.when(F.col("vec_id").isNull() | F.col("key").isNull(), 0).otherwise(F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    return out.select("vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def embedding_join_query(vectors: DataFrame) -> DataFrame:
    return near_duplicate_vectors(vectors)
