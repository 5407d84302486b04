"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

CHUNK = 1 << 21


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b), and the smallest node that each can reach."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        ru, rv = root[u], root[v]
        open_ = ru != rv
        if not open_.any():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(ru, rv)[open_], np.minimum(ru, rv)[open_])
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one partition, in bounded chunks, as stars around their smallest nodes."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(i).to_numpy(zero_copy_only=False) for x in held]) for i in (0, 1))
        nodes, root = smallest_reachable(a, b)
        keep = nodes != root
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(root[keep])], names=["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            yield stars(held)
            held, n = [], 0
    if n:
        yield stars(held)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges has long columns a and b. Returns node, component (the smallest node reachable) for each node of an edge between two nodes.

    Null ends and loops are left out; repeated edges count once. Each round is two shuffles of the edges; the number of rounds
    grows with the logarithm of a component's size. No component meets in one task: minima are pre-aggregated, and a hub's rows
    stand in a join that adaptive execution may split.
    """
    now = written(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).mapInArrow(_local_stars, "u long, v long"), "stars")
    state = None
    while True:
        tally = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        if tally == state or not tally[0]:
            out = written(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
            discard(now)
            return out
        state = tally
        before, now = now, written(_small_star(_large_star(now)), "stars")
        discard(before)
