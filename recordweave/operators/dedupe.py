"""Order-preserving deduplication, exclusion and matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordweave.shared import keep


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def within_quota(df: DataFrame, keys: list[str], order: list, quota: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= quota).drop("_n")


def first_then_quota(df: DataFrame, key: str, source: str, order: list, quota: int) -> DataFrame:
    """The first row of each key, and of those at most `quota` of each source: a key that the quota refuses still counts as seen."""
    return within_quota(first_by(df, [key], order), [source], order, quota)


def greedy(df: DataFrame, pos: str, keys: list[str]) -> DataFrame:
    """The rows that one pass in the order of `pos` keeps, if a row goes whenever it shares a non-null key with one kept before.

    Rounds in place of a pass: every row that is the first undecided one of all its keys
    stays, and what shares a key with it goes.  Decisions of a round are kept in the
    checkpoint folder, and so are those taken so far.  There are as many rounds as the
    longest chain of rows of which each waits for the one before: in random orders the
    logarithm of the rows, at worst (every row shares a key with the next) half of them.
    Rows without keys stay.
    """
    tagged = F.array_compact(F.array(*(F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{i}:"), F.col(k).cast("string"))) for i, k in enumerate(keys))))
    state = df.select(F.col(pos).alias("_pos"), tagged.alias("_keys"))
    taken, open_ = state.where(F.size("_keys") == 0).select("_pos"), keep(state.where(F.size("_keys") > 0))
    while not open_.isEmpty():
        flat = open_.select("_pos", F.explode("_keys").alias("_key"))
        firsts = flat.groupBy("_key").agg(F.min("_pos").alias("_first"))
        led = flat.join(firsts, "_key").groupBy("_pos").agg(F.bool_and(F.col("_pos") == F.col("_first")).alias("_kept"))
        kept = keep(led.where("_kept").select("_pos"))
        gone = flat.join(flat.join(kept, "_pos", "left_semi").select("_key").distinct(), "_key", "left_semi").select("_pos").distinct()
        taken = keep(taken.unionByName(kept))
        open_ = keep(open_.join(gone, "_pos", "left_anti"))
    return df.join(taken.withColumnRenamed("_pos", pos), pos, "left_semi")


def exclude(df: DataFrame, *histories: tuple[DataFrame, str]) -> DataFrame:
    """df without the rows whose column of that name occurs in a history; null keys never match."""
    for history, key in histories:
        df = df.join(history.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return df


def unique_match(left: DataFrame, right: DataFrame, key: list[str], value: str, default: str) -> DataFrame:
    """left with the value of the only right row of its key; `default` where none or several match."""
    only = right.groupBy(*key).agg(F.count("*").alias("_n"), F.min(value).alias(value)).where("_n = 1").drop("_n")
    return left.join(only, key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def mark(df: DataFrame, known: DataFrame, key: str, column: str, value: Column, only: Column) -> DataFrame:
    """Sets `column` to value where the key is known and `only` holds."""
    seen = known.select(key).distinct().withColumn("_seen", F.lit(True))
    return df.join(seen, key, "left").withColumn(column, F.when(F.col("_seen") & only, value).otherwise(F.col(column))).drop("_seen")
