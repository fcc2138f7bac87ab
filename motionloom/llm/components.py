"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Edges (two numbers each) that one task puts together; more are shuffled, round by round.
FEW_EDGES = 1_000_000


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node that each reaches) of edges: least labels pass along edges and to the labels' own labels."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b):
            np.minimum.at(new, end, least)
            np.minimum.at(new, label[end], least)  # a label's node learns of the smaller one too
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            node, label = least_reachable(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            for k in range(0, len(node), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(node[k : k + 50_000]), pa.array(label[k : k + 50_000])], ["node", "label"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "node long, label long")


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One step. Large: the larger neighbours of u get u's least neighbour; small: the smaller ones do.

    The least neighbour comes from an aggregation with partial sums and goes back by a
    join, so a vertex with very many neighbours never needs them in one task.
    """
    if small:
        sided = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    else:
        sided = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = sided.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = sided.join(least, "u")
    if small:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v"))
        )
    else:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) for every node of edges (u, v); label is the least node reachable.

    Loops and repeated edges are allowed, nulls are ignored, and an empty table gives
    an empty one. Up to FEW_EDGES edges are put together in one task; of more, the rounds
    grow with the logarithm of the longest path.
    """
    now = written(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), name)
    if now.count() <= FEW_EDGES:
        return _in_one_task(now)
    mark = None
    while True:
        at = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (at.n, at.s) == mark or not at.n:
            break
        mark = (at.n, at.s)
        now = written(_stars(_stars(now, small=False), small=True), name)
    pairs = now.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("label"))
    return pairs.union(pairs.select(F.col("label").alias("node"), "label").distinct())
