"""Recovered mailboxes in two tables and their report."""

from pyspark.sql import functions as F

from recordweave.operators import recovery
from recordweave.sources import tables


def test_recovery_updates_both_tables(spark, tmp_path):
    leads = spark.createDataFrame([(1, "a.example", "", "", "s1"), (2, "b.example", "Not Found", "Not Found", ""), (3, "c.example", "have@c.example", "t", "s3"), (4, None, "", "", ""), (5, "d.example", None, None, None), (6, "e.example", "", "", "")], "row long, domain string, email string, email_type string, source string")
    drafts = spark.createDataFrame([(10, "a.example", "", "", "x"), (11, "a.example", "old@a.example", "t", "y"), (12, "b.example", "not found", "", ""), (13, "zzz", "", "", "")], "id long, domain string, email string, email_type string, source string")
    found = spark.createDataFrame([("a.example", "second@a.example", "G", "https://a.example/2", 2), ("a.example", "first@a.example", "G", "https://a.example/1", 1), ("b.example", "info@b.example", "G", "https://b.example", 0), ("c.example", "no@c.example", "G", "u", 0), ("e.example", "late@e.example", "G", "u", 0)], "domain string, email string, email_type string, url string, rank int")
    new_leads, new_drafts, report = recovery.recover(leads, drafts, found, F.col("email") != "info@b.example", at_most=3)
    assert {r.row: (r.email, r.source, r.recovered) for r in new_leads.collect()} == {1: ("first@a.example", "s1; https://a.example/1", True), 2: ("info@b.example", "https://b.example", True), 3: ("have@c.example", "s3", False), 4: ("", "", False), 5: (None, None, False), 6: ("", "", False)}
    assert {r.id: (r.email, r.recovered) for r in new_drafts.collect()} == {10: ("first@a.example", True), 11: ("old@a.example", False), 12: ("info@b.example", True), 13: ("", False)}
    assert [tuple(r) for r in report.collect()] == [(3, 2, 1, 1)]
    assert new_leads.drop("recovered").columns == leads.columns or set(new_leads.drop("recovered").columns) == set(leads.columns)
    assert tables.replace(new_leads.drop("recovered"), f"file://{tmp_path}/l") == tables.replace(new_drafts.drop("recovered"), f"file://{tmp_path}/d") == 1


def test_nothing_to_recover(spark):
    leads = spark.createDataFrame([], "row long, domain string, email string, email_type string, source string")
    drafts = spark.createDataFrame([(1, "a", "x@a", "t", "")], "id long, domain string, email string, email_type string, source string")
    found = spark.createDataFrame([], "domain string, email string, email_type string, url string, rank int")
    _, kept, report = recovery.recover(leads, drafts, found, F.lit(True))
    assert [tuple(r) for r in report.collect()] == [(0, 0, 0, 0)] and kept.count() == 1
