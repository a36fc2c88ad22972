"""Keyed state as batch queries: streaks, cool-downs, carried values, cadence, fallback and circuit breaker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zero_runs(df: DataFrame, key: str, order: list, hit: Column) -> DataFrame:
    """key, run, zeros: the length of each run of rows without a hit; run counts the hits before it."""
    w = Window.partitionBy(key).orderBy(*order)
    runs = df.withColumn("_hit", hit.cast("int")).withColumn("run", F.sum("_hit").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy(key, "run").agg(F.sum(1 - F.col("_hit")).alias("zeros"))


def growth(runs: DataFrame, key: str, limit: int = 3) -> DataFrame:
    """key, level (how often a run reached the limit and began anew), streak (zeros since)."""
    last = F.max_by(F.col("zeros"), F.col("run"))
    return runs.groupBy(key).agg(F.sum(F.floor(F.col("zeros") / limit)).cast("long").alias("level"), (last % limit).cast("long").alias("streak"))


def trailing_zeros(runs: DataFrame, key: str) -> DataFrame:
    return runs.groupBy(key).agg(F.max_by("zeros", "run").cast("long").alias("zero_streak"))


def negative_cache(df: DataFrame, domain: str, source: str, at: str, found: Column, now: Column, days: int = 14) -> DataFrame:
    """domain, source, state per domain and source: found (sticky for the domain), cooling down or retry."""
    marked = df.withColumn("_found", found)
    ever = F.max("_found").over(Window.partitionBy(domain))
    last = marked.withColumn("_ever", ever).groupBy(domain, source).agg(F.max("_ever").alias("_ever"), F.max(F.when(~F.col("_found"), F.col(at))).alias("_miss"))
    until = F.col("_miss") + F.expr(f"interval {days} days")
    return last.select(domain, source, F.when(F.col("_ever"), "found").when(now < until, "cooldown").otherwise("retry").alias("state"))


def carried(df: DataFrame, key: str, order: list, value: Column) -> Column:
    """The last non-null value up to each row."""
    return F.last_value(value, ignoreNulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def next_due(due: Column, done: Column, ok: Column, seconds: int = 19_800) -> Column:
    """After success the next whole step from the due time that is past `done`, so the cadence doesn't drift; after failure the step counts from `done`.  All in epoch seconds."""
    steps = F.floor((done - due) / seconds) + 1
    return F.when(~ok, done + seconds).when(due <= done, due + seconds * steps).otherwise(due)


def fallback(df: DataFrame, query: str, priority: str) -> DataFrame:
    """Of each query the rows of the first provider that has any."""
    return df.withColumn("_first", F.min(priority).over(Window.partitionBy(query))).where(F.col(priority) == F.col("_first")).drop("_first")


def circuit(df: DataFrame, provider: str, order: list, failed: Column, limit: int = 2) -> DataFrame:
    """The rows attempted before the provider had failed `limit` times."""
    before = Window.partitionBy(provider).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_failures", F.coalesce(F.sum(failed.cast("int")).over(before), F.lit(0))).where(F.col("_failures") < limit).drop("_failures")
