"""Queries that are to read every row."""

from pyspark.sql import functions as F

from recordweave.plans import catalog


def test_lexicons_read_every_language(spark, sf):
    docs = catalog.table(spark, sf, "documents")
    assert catalog.QUERIES["lexicon_hits_all"](spark, sf).count() == docs.count() > docs.where("lang = 'en'").count()
    others = catalog.QUERIES["term_learning_all"](spark, sf).join(docs, "doc_id").where("lang <> 'en'")
    assert others.count() > 0


def test_resume_reads_every_event(spark, sf):
    todo = catalog.QUERIES["resume_anti_all"](spark, sf)
    e = catalog.table(spark, sf, "events")
    bought = {(r.user_id, r.ts.date()) for r in e.where("event_type = 'purchase'").collect()}
    assert {r.event_id for r in todo.collect()} == {r.event_id for r in e.collect() if (r.user_id, r.ts.date()) not in bought}
    assert todo.where(F.col("event_id") % 2 == 0).count() > 0
