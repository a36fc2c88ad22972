"""Approximate nearest neighbours by cosine: a forest of random-projection trees.

Each tree halves the unit vectors level by level, along one random direction a level, at
the median of a bounded sample; every vector falls into one leaf of each tree.  A query
walks all trees through one priority queue, nearest boundaries first, until the leaves it
has reached hold its budget of candidates; these are then ranked by their exact cosine.

The budget isn't guessed: on two nested samples the search is held against brute force,
and the share of the vectors it has to reach is carried on to all vectors by the power law
through the two.  Where the data lie close to few directions that share falls fast as they
grow; where they are spread evenly over many dimensions, no tree can prune much.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordweave.llm.common import cut

#: Leaves that are ranked together: one row of a query reaches them all, by a mask of so many bits.
BLOCK = 32


@dataclass
class Forest:
    """Complete trees: directions (trees, depth, d), cuts (trees, nodes); the children of node i are 2i+1 and 2i+2, the leaves follow the nodes."""

    directions: np.ndarray
    cuts: np.ndarray

    @property
    def depth(self) -> int:
        return self.directions.shape[1]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(vectors, trees): the leaf of each unit vector in each tree."""
        out = np.empty((len(x), len(self.cuts)), np.int64)
        for t, (directions, cuts) in enumerate(zip(self.directions, self.cuts, strict=True)):
            node, p = np.zeros(len(x), np.int64), x @ directions.T
            for level in range(self.depth):
                node = 2 * node + 1 + (p[:, level] > cuts[node])
            out[:, t] = node - len(cuts)
        return out

    def walk(self, x: np.ndarray) -> Iterator[tuple[int, int]]:
        """(tree, leaf) in the order a query reaches them: by the sum of the squared distances to the boundaries that lie between."""
        p, cuts, nodes = (self.directions @ x).tolist(), self.cuts, self.cuts.shape[1]
        heap = [(0.0, t, 0, 0) for t in range(len(cuts))]
        while heap:
            far, t, i, level = heappop(heap)
            while i < nodes:
                m = p[t][level] - cuts[t, i]
                near, other = (2 * i + 2, 2 * i + 1) if m > 0 else (2 * i + 1, 2 * i + 2)
                level += 1
                heappush(heap, (far + m * m, t, other, level))
                i = near
            yield t, i - nodes


def fit_forest(x: np.ndarray, trees: int, depth: int, seed: int = 7) -> Forest:
    """A forest for unit vectors like those of the sample x."""
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((trees, depth, x.shape[1]))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    cuts = np.zeros((trees, 2**depth - 1))
    for t in range(trees):
        p, node = x @ directions[t].T, np.zeros(len(x), np.int64)
        for level in range(depth):
            order = np.lexsort((p[:, level], node))
            at = np.searchsorted(node[order], np.arange(2**level + 1) + 2**level - 1)
            some = np.flatnonzero(at[1:] > at[:-1])
            middle = (at[:-1] + at[1:])[some]
            cuts[t, 2**level - 1 + some] = (p[order[(middle - 1) // 2], level] + p[order[middle // 2], level]) / 2
            node = 2 * node + 1 + (p[:, level] > cuts[t, node])
    return Forest(directions, cuts)


def depth_for(rows: int, leaf: int) -> int:
    """The depth at which leaves hold about `leaf` of the rows; 14 at most, as the sizes of all leaves go through the driver."""
    return int(np.clip(round(np.log2(max(rows, 1) / leaf)), 1, 14))


def reached(forest: Forest, sizes: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(tree, leaf, share of all vectors that the leaves so far hold): a vector is in one leaf of each tree, and trees are taken as independent."""
    total, held, missed = float(sizes[0].sum()), [0] * len(sizes), 1.0
    for t, leaf in forest.walk(x):
        n = int(sizes[t, leaf])
        if n:
            if total > held[t]:
                missed *= (total - held[t] - n) / (total - held[t])
            held[t] += n
            yield t, leaf, 1 - missed


def share_needed(x: np.ndarray, k: int, trees: int, leaf: int, recall: float, queries: int = 100) -> float:
    """The share of the unit vectors x to be reached so that the k nearest of its first rows are found with that recall."""
    forest = fit_forest(x, trees, depth_for(len(x), leaf))
    leaves = forest.leaves(x)
    sizes = np.stack([np.bincount(c, minlength=2**forest.depth) for c in leaves.T])
    needed = []
    for i in range(min(queries, len(x))):
        s = x @ x[i]
        s[i] = -np.inf
        best = np.argpartition(-s, min(k, len(s) - 1))[:k]
        goal = {j: leaves[j] for j in best.tolist()}
        for t, at, share in reached(forest, sizes, x[i]):
            found = [j for j, own in goal.items() if own[t] == at]
            for j in found:
                del goal[j]
                needed.append(share)
            if not goal:
                break
    return float(np.quantile(needed, recall))


def budget_share(x: np.ndarray, rows: int, k: int, trees: int, leaf: int, recall: float, floor: int = 2000) -> float:
    """The share of `rows` vectors like the sample x that a query has to reach.

    Measured on x and on the first quarter of it, and carried on by the power law through
    both, downwards alone; everything where there are too few rows to measure on.
    """
    if rows <= floor or len(x) <= floor:
        return 1.0
    much = share_needed(x, k, trees, leaf, recall)
    if rows <= len(x):
        return much
    less = share_needed(x[: len(x) // 4], k, trees, leaf, recall)
    slope = min(0.0, log(much / less) / log(len(x) / (len(x) // 4)))
    return much * (rows / len(x)) ** slope


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not zero, without null or non-finite components."""
    wide = vector.cast("array<double>")
    return vector.isNotNull() & F.forall(wide, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(wide, lambda v: v != 0)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


_ROW = "tree int, block int, part int, side int, id long, mask long, ids array<long>, v binary"


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, trees: int = 8, leaf: int = 64, recall: float = 0.96, sample_numbers: int = 1 << 20, part_rows: int = 16_384, share: float | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found for each row of vectors(vec_id, embedding) whose vec_id is divisible by `every`.

    Candidates are all rows but the query's own; nearest first, ties to the smaller
    vec_id; all candidates if there are fewer than k.  Rows whose vector is not usable(),
    or not of the most frequent dimension (the smaller among equals), or whose vec_id is
    null take no part; a repeated vec_id is one point, as near as its nearest vector.
    Equal vectors are one entry with its k + 1 smallest ids, which loses no result, so
    copies of any number cost one entry.  An empty table gives no rows; other columns are
    not read.

    The forest is fitted on the driver on at most sample_numbers components, of the
    vectors whose hashes come first; every vector is indexed.  A query's budget is the
    share of the vectors that budget_share measures for `recall` on that sample, or
    `share` if given.  Members of a group of leaves are ranked in parts of about part_rows,
    which a task holds; the queries that reach a part stream past it, however many.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    shape = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = shape.d
    rows = rows.where(F.size("embedding") == d)
    wide = np.dtype("<f4" if rows.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8")
    number = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    first = cut(rows.distinct().withColumn("n", number).where(F.col("n") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    n = first.count()
    many = max(1, min(20_000, sample_numbers // d))
    chance = F.pmod(F.xxhash64("embedding"), F.lit(1 << 30))
    few = first.where(chance < F.lit(int(min(1.0, 1.5 * many / n) * (1 << 30)))).select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(many).toArrow()
    sample = _unit(_matrix(few.column("embedding").combine_chunks(), d)) if few.num_rows else np.eye(d)[:1]
    forest = fit_forest(sample, trees, depth_for(n, leaf))
    enough = budget_share(sample, n, k, trees, leaf, recall) if share is None else share

    def placed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            x = _matrix(b.column("embedding"), d)
            yield pa.RecordBatch.from_arrays([b.column("ids"), pa.array([v.astype(wide).tobytes() for v in x], pa.binary()), pa.array(list(forest.leaves(_unit(x))), pa.list_(pa.int64()))], ["ids", "v", "leaves"])

    index = cut(first.mapInArrow(placed, "ids array<long>, v binary, leaves array<long>"))
    per_leaf = index.select(F.posexplode("leaves").alias("tree", "leaf")).groupBy("tree", "leaf").count().collect()  # trees * 2 ** depth rows at most
    sizes = np.zeros((trees, 2**forest.depth), np.int64)
    for r in per_leaf:
        sizes[r.tree, r.leaf] = r["count"]
    parts = -(-sizes.reshape(trees, -1, min(BLOCK, 2**forest.depth)).sum(2) // part_rows)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("tree", pa.int32()), ("block", pa.int32()), ("part", pa.int32()), ("side", pa.int32()), ("id", pa.int64()), ("mask", pa.int64()), ("ids", pa.list_(pa.int64())), ("v", pa.binary())])
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b, out = whole.slice(lo, 500), []
                x = _matrix(b.column("embedding"), d)
                for q, raw, unit in zip(b.column("vec_id").to_pylist(), x, _unit(x), strict=True):
                    masks: dict[tuple[int, int], int] = {}
                    for t, at, held in reached(forest, sizes, unit):
                        g = t, at // BLOCK
                        masks[g] = masks.get(g, 0) | 1 << at % BLOCK
                        if held >= enough:
                            break
                    v = raw.astype(wide).tobytes()
                    out += [{"tree": t, "block": g, "part": p, "side": 1, "id": q, "mask": m, "v": v} for (t, g), m in masks.items() for p in range(int(parts[t, g]))]
                yield pa.RecordBatch.from_pylist(out, schema)

    queries = rows.where(F.col("vec_id") % every == 0).distinct().mapInArrow(walked, _ROW)
    count = F.lit(parts.tolist()).cast("array<array<int>>")
    members = index.select(F.posexplode("leaves").alias("tree", "leaf"), "ids", "v").withColumn("block", F.floor(F.col("leaf") / BLOCK).cast("int"))
    members = members.select("tree", "block", F.pmod(F.xxhash64("v"), count[F.col("tree")][F.col("block")]).cast("int").alias("part"), F.lit(0).alias("side"), F.lit(0).cast("long").alias("id"), (F.col("leaf") % BLOCK).cast("long").alias("mask"), "ids", "v")

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by group, members before queries; a member's mask is its leaf's place."""
        now, v, ids, place, x = None, [], [], [], None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in ("tree", "block", "part", "side")])
            at = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(at, at[1:], strict=False):
                if lo == hi:
                    continue
                *key, side = keys[:, lo].tolist()
                if key != now:
                    now, v, ids, place, x = key, [], [], [], None
                piece = b.slice(lo, hi - lo)
                if side == 0:
                    v += piece.column("v").to_pylist()
                    ids += piece.column("ids").to_pylist()
                    place += piece.column("mask").to_pylist()
                    continue
                if not v:
                    continue
                if x is None:
                    x, where = _unit(np.frombuffer(b"".join(v), wide).reshape(-1, d)), np.array(place)
                for q in range(0, len(piece), 256):
                    yield _best(piece.slice(q, 256), x, where, ids, wide, k)

    by = ["tree", "block", "part"]
    both = members.unionByName(queries).repartition(*by).sortWithinPartitions(*by, "side")
    best = both.mapInArrow(ranked, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(queries: pa.RecordBatch, x: np.ndarray, place: np.ndarray, ids: list[list[int]], wide: np.dtype, k: int) -> pa.RecordBatch:
    """The k nearest of the members x for each query among those of the leaves it reaches, and all that tie with the last."""
    score = _unit(np.frombuffer(b"".join(queries.column("v").to_pylist()), wide).reshape(-1, x.shape[1])) @ x.T
    score[(queries.column("mask").to_numpy()[:, None] >> place) & 1 == 0] = -np.inf
    out = []
    for query, s in zip(queries.column("id").to_pylist(), score, strict=True):
        # The query's own entry and k more, and all that tie with the last.
        floor = np.partition(s, -(k + 1))[-(k + 1)] if len(s) > k + 1 else -np.inf
        best = np.flatnonzero((s >= floor) & (s > -np.inf))
        out += [(query, v, -n) for n, v in sorted((-s[i], v) for i in best.tolist() for v in ids[i] if v != query)[:k]]
    q, v, n = zip(*out, strict=True) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(n, pa.float64())], ["query_id", "vec_id", "score"])
