"""Exact top-k by Hamming distance: incremental multi-index hashing of 64-bit codes.

Codes are cut into m segments, each indexed by its value.  Round r looks up every value
that differs in r bits from a query's segment; after it all codes within m * (r + 1) - 1
bits are known, since a code further off in every segment differs in m * (r + 1) bits.  A
query is done once its k-th verified distance is within that.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordweave.llm.ann import usable
from recordweave.llm.common import cut

SAMPLE = 512


def sign_code(vector: Column) -> Column:
    """Bit i mod 64 is the parity of the positive components i, i + 64 ...: for 64 components or fewer, their signs."""
    bits = F.transform(vector, lambda v, i: F.when(v > 0, F.call_function("shiftleft", F.lit(1).cast("long"), (i % 64).cast("int"))).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))


def codes_of(vectors: DataFrame) -> DataFrame:
    """vec_id, code of the usable rows of vectors(vec_id, embedding) whose vec_id is not null."""
    return vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long"), sign_code(F.col("embedding")).alias("code"))


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def nearest_codes(codes: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank (from 1), vec_id, distance: exactly the k nearest of all rows but the query's own, ties to the smaller vec_id.

    Queries are the rows of codes(vec_id, code) whose vec_id is divisible by `every`; all
    candidates if there are fewer than k.  Null ids and codes take no part; a repeated
    vec_id is one point, as near as its nearest code.  Equal codes are one entry with its
    k + 1 smallest ids, which loses no result.  An empty table gives no rows.

    An entry reaches the output of a look-up only if it is no further than the k-th of a
    fixed sample of SAMPLE entries, or of what is found so far, so rounds stay small.
    """
    rows = codes.where("vec_id is not null and code is not null").select("vec_id", "code").distinct()
    number = F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))
    entries = cut(rows.withColumn("n", number).where(F.col("n") <= k + 1).groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    n = entries.count()
    width = min(16, max(4, int(log2(max(n, 2))) - 5))  # about 2 ** 5 entries share a segment's value
    m = -(-64 // width)
    at = [64 * i // m for i in range(m + 1)]
    cuts = [(a, b - a) for a, b in zip(at, at[1:], strict=False)]

    def segments(code: Column) -> Column:
        return F.array(*(F.struct(F.lit(i).alias("segment"), F.shiftrightunsigned(code, low).bitwiseAND(F.lit((1 << size) - 1)).cast("int").alias("value")) for i, (low, size) in enumerate(cuts)))

    index = entries.select("code", "ids", F.explode(segments(F.col("code"))).alias("s")).select("s.*", "code", "ids")
    sample = [r.code for r in entries.orderBy(F.xxhash64("code"), "code").select("code").limit(SAMPLE).collect()]
    far = F.lit(64)
    if len(sample) > k:
        far = F.array_sort(F.transform(F.lit(sample), lambda c: _distance(c, F.col("qcode"))))[k]
    active = cut(rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("code").alias("qcode")).withColumn("far", far.cast("int")))
    top = codes.sparkSession.createDataFrame([], "query_id long, vec_id long, distance int")
    radius = 0
    while radius <= max(size for _, size in cuts) and not active.isEmpty():
        masks = F.coalesce(*(F.when(F.col("s.segment") == i, F.filter(F.sequence(F.lit(0), F.lit((1 << size) - 1)), lambda x: F.bit_count(x) == radius)) for i, (_, size) in enumerate(cuts)))
        probes = active.select("query_id", "qcode", "far", F.explode(segments(F.col("qcode"))).alias("s"))
        probes = probes.select("query_id", "qcode", "far", "s.segment", F.col("s.value").alias("v"), F.explode(masks).alias("mask"))
        probes = probes.select("query_id", "qcode", "far", "segment", F.col("v").bitwiseXOR(F.col("mask")).alias("value"))
        met = probes.join(index, (probes.segment == index.segment) & (probes.value == index.value) & (_distance(probes.qcode, index.code) <= probes.far))
        new = met.select("query_id", F.explode("ids").alias("vec_id"), _distance(F.col("qcode"), F.col("code")).alias("distance")).where("vec_id <> query_id")
        best = top.unionByName(new).groupBy("query_id", "vec_id").agg(F.min("distance").alias("distance"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
        top = cut(best.withColumn("rank", rank).where(F.col("rank") <= k)).select("query_id", "vec_id", "distance")
        known = top.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("kth"))
        nearer = F.when(F.col("n") >= k, F.least("far", "kth")).otherwise(F.col("far"))
        covered = m * (radius + 1) - 1
        active = cut(active.join(known, "query_id", "left").select("query_id", "qcode", nearer.alias("far")).where(F.col("far") > covered))
        radius += 1
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return top.select("query_id", rank.alias("rank"), "vec_id", "distance")
