"""Budgets that many rows share in one order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordweave.shared import keep


def running_total(df: DataFrame, order: list[str], cost: Column, name: str = "spent") -> DataFrame:
    """df with the sum of cost over all rows up to and with its own, in the order of these columns, which must tell all rows apart.

    Rows are dealt into ranges of the order and kept; each range's total is carried to the
    ranges after it (a number for each range reaches the driver), and within a range a
    window adds up.  A null cost counts as 0, null keys come first.  Rows that agree in all
    columns of the order are summed in no defined order among themselves.
    """
    dealt = keep(df.withColumn("_cost", F.coalesce(cost.cast("long"), F.lit(0))).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = {r["_part"]: r["_total"] for r in dealt.groupBy("_part").agg(F.sum("_cost").alias("_total")).collect()}
    carried, rows = 0, []
    for part in sorted(totals):
        rows.append((part, carried))
        carried += totals[part]
    before = df.sparkSession.createDataFrame(rows, "_part int, _carried long")
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row for each range, however many rows there are.
    return dealt.withColumn("_sum", F.sum("_cost").over(inside)).join(F.broadcast(before), "_part").withColumn(name, F.col("_sum") + F.col("_carried")).drop("_part", "_cost", "_sum", "_carried")


def within_budget(df: DataFrame, order: list[str], cost: Column, budget: int, name: str = "allowed") -> DataFrame:
    """df with whether each row's cost is still covered when those before it have been charged, the first refusal not ending it: as running_total counts, refused rows are charged too."""
    return running_total(df, order, cost, "_spent").withColumn(name, F.col("_spent") <= budget).drop("_spent")
