"""Connected components of an edge table by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordweave.llm.common import fresh


#: Rows of a partition of what the rounds keep, at least; edges (16 bytes each) that one task joins at the end.
ROWS, FEW = 50_000, 200_000


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ends of the edges a-b, and the smallest reachable one of each."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while True:
        i, j = up[x], up[y]
        if (i == j).all():
            return nodes, nodes[up]
        np.minimum.at(up, np.maximum(i, j), np.minimum(i, j))
        while (up != up[up]).any():
            up = up[up]


def _in_one_task(edges: DataFrame) -> DataFrame:
    """v, p: the roots of few edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
        if held:
            yield pa.RecordBatch.from_arrays([*map(pa.array, joined(*map(np.concatenate, zip(*held, strict=True))))], ["v", "p"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "v long, p long")


def _to_roots(parents: DataFrame, parts: int) -> DataFrame:
    """Pointer jumping: p of every v becomes the root of its tree, in rounds of two jumps, which quarter the depth."""

    def jump(nodes: DataFrame) -> DataFrame:
        up = nodes.select(F.col("v").alias("p"), F.col("p").alias("q"))
        return nodes.select("v", "p").join(up, "p", "left").select("v", F.coalesce("q", "p").alias("p"), F.coalesce(F.col("q") != F.col("p"), F.lit(False)).alias("moved"))

    while True:
        # Where the second jump moves no node, all have arrived.
        parents = fresh(jump(jump(parents)), parts)
        if not parents.agg(F.max("moved")).first()[0]:
            return parents.select("v", "p")


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for each node of edges(a long, b long); self-loops are allowed.

    A round hangs every node under its smallest neighbour, follows the trees to their
    roots and replaces the ends of every edge by roots; at least half of the nodes that
    still have edges vanish each time.  Minima are taken before the shuffle, so a hub is
    one row from each task; each round is kept in the shared folder, in no more parts than
    its edges need.  Once at most FEW edges are left, one task joins them.
    """
    edges = fresh(edges.where("a is not null and b is not null").select("a", "b").distinct())
    every = -(-edges.count() // ROWS) or 1
    total = fresh(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), 2 * every)
    edges = edges.where("a <> b")
    while left := edges.count():
        parts = -(-left // ROWS)
        if left <= FEW:
            roots = _in_one_task(edges)
            return fresh(total.join(roots, total.component == roots.v, "left").select("node", F.coalesce("p", "component").alias("component")), 2 * every)
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
        roots = _to_roots(both.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("v", "u").alias("p")), 2 * parts)
        total = fresh(total.join(roots, total.component == roots.v, "left").select("node", F.coalesce("p", "component").alias("component")), 2 * every)
        at_a, at_b = roots.toDF("a", "pa"), roots.toDF("b", "pb")
        edges = fresh(edges.join(at_a, "a").join(at_b, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), parts)
    return total
