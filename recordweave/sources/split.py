"""One pass over new records, three results: those accepted, those rejected, and what was counted on the way (K4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from recordweave.operators import dedupe
from recordweave.sources import tables


def append(new: DataFrame, folder: str, key: Column, order: list[str]) -> dict[str, int]:
    """Adds the rows of new whose key no earlier version and no row before them has; returns added, skipped and total.

    The rows are flagged and written once, by flag; the counts are observed in that write.
    accepted() is all that was ever added, rejected() what the last call refused, metrics()
    a row of counts for each version.  A null key counts as one key like any other.
    """
    spark = new.sparkSession
    known = tables.versions(spark, f"{folder}/rows")
    keyed = new.withColumn("_key", F.coalesce(key.cast("string"), F.lit("")))
    first = dedupe.first_by(keyed.select("_key", *order), ["_key"], order).select(*order).withColumn("_new", F.lit(True))
    flagged = keyed.join(first, order, "left")
    total = 0
    if known:
        old = accepted(spark, folder)
        total = old.count()
        flagged = flagged.join(old.select(F.coalesce(key.cast("string"), F.lit("")).alias("_key")).distinct().withColumn("_old", F.lit(True)), "_key", "left")
    else:
        flagged = flagged.withColumn("_old", F.lit(None).cast("boolean"))
    flagged = flagged.withColumn("kind", F.when(F.col("_new") & F.col("_old").isNull(), "accepted").otherwise("rejected")).drop("_new", "_old", "_key")
    seen = Observation()
    counted = flagged.observe(seen, F.count_if(F.col("kind") == "accepted").alias("added"), F.count_if(F.col("kind") == "rejected").alias("skipped"))
    version = tables.replace(counted, f"{folder}/rows", partition="kind")
    got = {name: seen.get[name] or 0 for name in ("added", "skipped")}
    got["total"] = total + got["added"]
    tables.append(spark.createDataFrame([(version, *got.values())], "version long, added long, skipped long, total long"), f"{folder}/metrics")
    return got


def accepted(spark: SparkSession, folder: str) -> DataFrame:
    return tables.every(spark, f"{folder}/rows").where("kind = 'accepted'").drop("kind")


def rejected(spark: SparkSession, folder: str) -> DataFrame:
    return tables.read(spark, f"{folder}/rows").where("kind = 'rejected'").drop("kind")


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/metrics")
