"""Mailboxes recovered for records that lack one, written to two tables and reported from both versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordweave.operators import dedupe
from recordweave.shared import keep

#: What stands for no mailbox.
MISSING = ("", "not found", "未公开/待核实")


def lacks(email: Column) -> Column:
    return F.lower(F.trim(F.coalesce(email, F.lit("")))).isin(*MISSING)


def recover(leads: DataFrame, drafts: DataFrame, found: DataFrame, eligible: Column, at_most: int = 50) -> tuple[DataFrame, DataFrame, DataFrame]:
    """leads and drafts with the mailboxes found for their domains, and a report of one row.

    leads and drafts have domain, email, email_type and source; leads also an order, row.
    The first `at_most` leads in that order that lack a mailbox and have a domain are
    processed.  found(domain, email, email_type, url, rank) has what their pages hold; the
    least rank counts.  A draft that lacks a mailbox takes that of its domain.  eligible is
    asked of the drafts as they are afterwards: safety_passed counts those recovered that
    meet it.  Null domains are never processed; rows that have a mailbox stay as they are.
    """
    open_ = leads.where(lacks(F.col("email")) & (F.coalesce("domain", F.lit("")) != "")).orderBy("row").limit(at_most)
    todo = keep(open_.select("domain", "row"))
    best = keep(dedupe.first_by(found.join(todo.select("domain").distinct(), "domain", "left_semi"), ["domain"], ["rank", "email"]).select("domain", F.col("email").alias("_email"), F.col("email_type").alias("_type"), F.col("url").alias("_url")))

    def filled(table: DataFrame, only: Column) -> DataFrame:
        take = F.col("_email").isNotNull() & lacks(F.col("email")) & only
        with_url = F.concat_ws("; ", F.nullif(F.trim("source"), F.lit("")), "_url")
        new = {"email": F.col("_email"), "email_type": F.col("_type"), "source": with_url}
        marked = table.join(best, "domain", "left").withColumn("_take", take)
        return marked.select(*(F.when(F.col("_take"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in table.columns), F.coalesce("_take", F.lit(False)).alias("recovered"))

    new_leads = keep(filled(leads.join(todo.select("row").withColumn("_todo", F.lit(True)), "row", "left"), F.coalesce("_todo", F.lit(False))).drop("_todo"))
    new_drafts = keep(filled(drafts, F.lit(True)))
    passed = new_drafts.where("recovered").where(eligible).agg(F.count("*").alias("safety_passed"))
    report = todo.agg(F.count("*").alias("processed")).join(new_leads.agg(F.count_if("recovered").alias("recovered")), F.lit(True)).join(passed, F.lit(True))
    report = report.select("processed", "recovered", "safety_passed", (F.col("processed") - F.col("recovered")).alias("not_found"))
    return new_leads, new_drafts, report
