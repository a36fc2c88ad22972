"""SimHash near-duplicates, linked through a Gray-order hierarchical index.

Distinct fingerprints are routed so that any two within the distance meet: of `distance`
+ 1 blocks of bits, two such fingerprints agree in one.  Where they meet, a hierarchical
index finds the links: the fingerprints in Gray-code order, in which neighbours share
most bits; every node holds the bits that all below it share and its parent does not;
a search adds up a query's differences from the root down and drops a whole group once
they pass the distance, or takes a whole group once they cannot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from recordweave.llm.common import cut
from recordweave.llm.components import components

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PLACES = (np.arange(8) * 256).astype(np.int64)
FAN = 16


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """The XXH64 (seed 42) of each shingle, repeats included; of all words where there are fewer than width; none without words."""
    if not words:
        return np.zeros(0, np.uint64)
    width = min(width, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths)[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(first, last, strict=True)), "<u8", len(first))


def majority(h: np.ndarray) -> int:
    """The unsigned 64-bit fingerprint: a bit is 1 if over half of the hashes have it."""
    if not len(h):
        return 0
    counts = np.zeros((8, 8), np.int64)
    for lo in range(0, len(h), 100_000):
        counts += np.bincount((h[lo : lo + 100_000].view(np.uint8).reshape(-1, 8) + _PLACES).ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(2 * counts > len(h), axis=1, bitorder="little").tobytes(), "little")


def words_of(text: str) -> list[bytes]:
    """The words: of bytes, so that A-Z alone are lower-cased, and only \\x20 and \\x09-\\x0D part them."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def fingerprint(text: str, width: int = 4) -> int:
    """The fingerprint of a text's shingles."""
    return majority(shingle_hashes(words_of(text), width))


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), a row for each row of docs; a null text counts as empty."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(hashed, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each 64-bit code in Gray-code order."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


class GrayIndex:
    """Levels from the codes (level 0, in Gray order) up; a node of level n covers FAN nodes of level n-1.

    mask has the bits that all codes below share, own those that the parent doesn't have, bits their values.
    """

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes = codes[self.order]
        all_, any_ = self.codes, self.codes
        self.mask, self.bits = [np.full(len(codes), ~np.uint64(0))], [self.codes]
        while len(all_) > FAN:
            at = np.arange(0, len(all_), FAN)
            all_, any_ = np.bitwise_and.reduceat(all_, at), np.bitwise_or.reduceat(any_, at)
            self.mask.append(~(all_ ^ any_))
            self.bits.append(all_ & self.mask[-1])
        self.own = [m & ~self.mask[n + 1][np.arange(len(m)) // FAN] if n + 1 < len(self.mask) else m for n, m in enumerate(self.mask)]

    def span(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes below a node, as places in Gray order."""
        return node * FAN**level, np.minimum((node + 1) * FAN**level, len(self.codes))

    def links(self, queries: np.ndarray, distance: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of places that link each query (a place) with what lies within the distance.

        group: the group of each place so far; nodes all in the query's own group are left
        out.  A node that lies within the distance as a whole gives a link to its first
        code and the links of its codes one to the next.
        """
        top, out = len(self.mask) - 1, []
        q, node = np.repeat(queries, len(self.mask[top])), np.tile(np.arange(len(self.mask[top])), len(queries))
        far = np.zeros(len(q), np.uint8)
        low, high = [group], [group]
        for n in range(top):
            at = np.arange(0, len(low[n]), FAN)
            low.append(np.minimum.reduceat(low[n], at))
            high.append(np.maximum.reduceat(high[n], at))
        for level in range(top, -1, -1):
            far = far + np.bitwise_count((self.codes[q] ^ self.bits[level][node]) & self.own[level][node])
            keep = (far <= distance) & ~((low[level][node] == high[level][node]) & (low[level][node] == group[q]))
            q, node, far = q[keep], node[keep], far[keep]
            if level == 0:
                out.append((q, node))
                break
            whole = far + np.bitwise_count(~self.mask[level][node]) <= distance
            if whole.any():
                a, b = self.span(level, node[whole])
                out.append((q[whole], a))
                for x, y in {*zip(a.tolist(), b.tolist(), strict=True)}:
                    out.append((np.arange(x, y - 1), np.arange(x + 1, y)))
                q, node, far = q[~whole], node[~whole], far[~whole]
            child = (node[:, None] * FAN + np.arange(FAN)).ravel()
            real = child < len(self.mask[level - 1])
            q, node, far = np.repeat(q, FAN)[real], child[real], np.repeat(far, FAN)[real]
        return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _merge(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """group, the smallest place of each group, after the links a-b."""
    while True:
        x, y = group[a], group[b]
        if (x == y).all():
            return group
        up = np.arange(len(group))
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up != up[up]).any():
            up = up[up]
        group = up[group]


def groups(codes: np.ndarray, distance: int, at_once: int = 2048) -> np.ndarray:
    """For each of these distinct codes the index of a member of its group, the same for all of a group."""
    if len(codes) == 1:
        return np.zeros(1, np.int64)
    index, group = GrayIndex(codes), np.arange(len(codes))
    for lo in range(0, len(codes), at_once):
        group = _merge(group, *index.links(np.arange(lo, min(lo + at_once, len(codes))), distance, group))
    out = np.empty(len(codes), np.int64)
    out[index.order] = index.order[group]
    return out


def _part(x: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(x, low).bitwiseAND(F.lit((1 << width) - 1))


def _cuts(bits: int, parts: int) -> list[tuple[int, int]]:
    at = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:], strict=False)]


def links(codes: DataFrame, distance: int = 4, largest: int = 4_000) -> DataFrame:
    """a, b: links that join the reps of all codes(fp, rep) within the distance, at most one for each code where it meets others.

    A block value that over `largest` distinct codes share is split once more by the
    blocks of the other bits, which loses no pair either.
    """

    def whole(x: Column, i: int, cuts) -> Column:
        low, width = cuts[i]
        rest = x if low == 0 else F.shiftrightunsigned(x, low).bitwiseOR(F.shiftleft(x, 64 - low))
        return F.struct((_part(x, low, width) + F.lit(i << 32)).alias("key"), rest.alias("turned"), F.lit(width).alias("width"))

    first = _cuts(64, distance + 1)
    keyed = codes.select("fp", "rep", F.explode(F.array(*(whole(F.col("fp"), i, first) for i in range(distance + 1)))).alias("k")).select("fp", "rep", "k.*")
    hot = keyed.groupBy("key").count().where(F.col("count") > largest).select("key", F.lit(True).alias("hot"))
    # What follows the block in the turned code are the other bits: of any distance + 1 disjoint blocks of them, one agrees.
    rest = _cuts(64 - max(w for _, w in first), distance + 1)
    deeper = F.array(*((F.shiftrightunsigned(F.shiftrightunsigned("turned", min(w for _, w in first)), low).bitwiseAND(F.lit((1 << width) - 1)) + F.lit(j << 32)) for j, (low, width) in enumerate(rest)))
    met = keyed.join(hot, "key", "left").select("fp", "rep", "key", F.explode(F.when(F.col("hot"), deeper).otherwise(F.array(F.lit(-1).cast("long")))).alias("sub"))
    met = met.repartition("key", "sub").sortWithinPartitions("key", "sub")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(fp, rep):
            fp, rep = np.concatenate(fp).view(np.uint64), np.concatenate(rep)
            g = groups(fp, distance)
            least = np.full(len(fp), np.iinfo(np.int64).max)
            np.minimum.at(least, g, rep)
            other = least[g] != rep
            return rep[other], least[g][other]

        held, fps, reps = None, [], []
        for b in batches:
            key, sub, fp, rep = (b.column(c).to_numpy() for c in ("key", "sub", "fp", "rep"))
            at = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (sub[1:] != sub[:-1])) + 1).tolist(), len(key)]
            out = []
            for lo, hi in zip(at, at[1:], strict=False):
                if lo == hi:
                    continue
                now = key[lo], sub[lo]
                if now != held:
                    if sum(map(len, fps)) > 1:
                        out.append(flush(fps, reps))
                    held, fps, reps = now, [], []
                fps.append(fp[lo:hi])
                reps.append(rep[lo:hi])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["a", "b"])
        if sum(map(len, fps)) > 1:
            yield pa.RecordBatch.from_arrays([*map(pa.array, flush(fps, reps))], ["a", "b"])

    return met.mapInArrow(linked, "a long, b long")


def _grouped(docs: DataFrame, distance: int, width: int) -> DataFrame:
    """doc_id, key (the fingerprint), component (the smallest fingerprint reachable), component_id, a row for each row of docs."""
    fps = cut(fingerprints(docs, width))
    codes = cut(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least")))
    comp = components(links(codes.select("fp", F.col("fp").alias("rep")), distance))
    named = codes.join(comp, codes.fp == comp.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    found = fps.join(named.join(least, "component").select("fp", "component", "component_id"), "fp", "left")
    known = F.col("doc_id").isNotNull()
    return found.select("doc_id", F.col("fp").alias("key"), F.when(known, F.col("component")).alias("component"), F.when(known, F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, distance: int = 4, width: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id (the smallest doc_id reachable), a row for each row of docs.

    What is linked are fingerprints: a doc_id that comes with several texts has a row, and
    maybe a component, for each of them, and does not join them.  A null text counts as
    empty; without words the fingerprint is zero, linked like any other.  Rows of a null
    doc_id have a null component_id and link nothing.  Repeated rows share their row's
    component.  An empty table gives no rows; columns other than doc_id and text are not
    read.  Copies meet as one fingerprint, so a group of any size costs one row from each
    task; no pairs are made.
    """
    return _grouped(docs, distance, width).select("doc_id", F.lpad(F.lower(F.hex("key")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, distance: int = 4, width: int = 4) -> DataFrame:
    """One document of each component of near_duplicates: that with the smallest doc_id, and of several under it that with the smallest fingerprint.

    Rows of a null doc_id stay; equal rows stay once; a text under a repeated doc_id goes
    only if its own component has another document that stays.
    """

    def keyed(rows: DataFrame) -> DataFrame:
        return with_key(rows, lambda t: np.uint64(fingerprint(t, width)).astype(np.int64))

    return first_of(docs, _grouped(docs, distance, width), keyed)


def with_key(rows: DataFrame, key: Callable[[str], int]) -> DataFrame:
    """rows with the column _key, a long made from each text; a null text counts as empty."""
    schema = StructType([*rows.schema.fields, StructField("_key", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("_key", pa.array([int(key(t or "")) for t in b.column("text").to_pylist()], pa.int64()))

    return rows.mapInArrow(run, schema)


#: So many ids, 40 bytes each, are broadcast at most; beyond that the join shuffles.
FEW = 1_000_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is among the distinct ids(doc_id), which are kept and counted first: few enough are broadcast, so no text moves."""
    ids = cut(ids)
    return docs.join(F.broadcast(ids) if ids.count() <= FEW else ids, "doc_id", "left_anti").select(docs.columns)


def within(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is among the distinct ids(doc_id), by the same way as without."""
    ids = cut(ids)
    return docs.join(F.broadcast(ids) if ids.count() <= FEW else ids, "doc_id", "left_semi").select(docs.columns)


def first_of(docs: DataFrame, found: DataFrame, keyed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of docs that stay of the components found (doc_id, key, component, component_id); keyed adds the column _key to rows of docs.

    Where every doc_id occurs once, documents other than their component's smallest go.
    Rows of repeated ids are told apart by their keys.
    """
    known = found.where("doc_id is not null")
    twice = cut(known.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if twice.isEmpty():
        return without(docs, known.where("doc_id <> component_id").select("doc_id"))
    first = known.where("doc_id = component_id").groupBy("component").agg(F.min("key").alias("_key"), F.min("doc_id").alias("doc_id"))
    once = without(docs, known.where("doc_id <> component_id").select("doc_id").unionByName(twice).distinct())
    again = keyed(docs.join(twice, "doc_id", "left_semi").select(docs.columns)).join(first.select("doc_id", "_key").distinct(), ["doc_id", "_key"], "left_semi")
    number = F.row_number().over(Window.partitionBy("doc_id", "_key").orderBy(F.to_json(F.struct(*docs.columns))))
    return once.unionByName(again.withColumn("_n", number).where("_n = 1").select(docs.columns))
