"""The lexicon of industries, job titles and procurement terms, with what was learned on top of it.

A library is a JSON document of nested lists; learned terms are rows with their evidence,
kept as a versioned table and added to by key.  Merged, first come the library's terms in
their order, then learned ones in theirs; of terms that differ in case alone the first stays (S10 S11 X15).
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from recordweave.functions import fixed
from recordweave.operators import dedupe
from recordweave.shared import keep
from recordweave.sources import tables

_LIBRARY = "industries map<string, array<string>>, job_titles array<string>, procurement_terms array<string>"
LEARNED = "term string, term_type string, industry string, source_url string, learned_at timestamp"
FAMILIES = ("products", "job_titles", "procurement_terms")
#: Terms that one text may teach.
MOST = 6


def library(spark: SparkSession, path: str) -> DataFrame:
    """term_type, industry, industry_pos, pos, term of a library's file; a missing part gives no rows, as does an empty document."""
    doc = spark.read.schema(_LIBRARY).option("multiLine", True).json(path)
    products = doc.select(F.posexplode(F.map_entries("industries")).alias("industry_pos", "e")).select("industry_pos", F.col("e.key").alias("industry"), F.posexplode("e.value").alias("pos", "term"))
    out = products.select(F.lit("products").alias("term_type"), "industry", "industry_pos", "pos", "term")
    for family in FAMILIES[1:]:
        out = out.unionByName(doc.select(F.lit(family).alias("term_type"), F.lit(None).cast("string").alias("industry"), F.lit(None).cast("int").alias("industry_pos"), F.posexplode(family).alias("pos", "term")))
    return out.where("term is not null")


def merged(base: DataFrame, learned: DataFrame) -> DataFrame:
    """term_type, industry, pos, term: library rows, then the learned ones in order of time and term, each term once for its family and industry whatever its case.

    Job titles and procurement terms have no industry.  Learned terms of a new industry
    come after all others; blank terms, and products of no industry, are left out.
    """
    scope = lambda: F.when(F.col("term_type") == "products", F.trim("industry"))
    early = base.select("term_type", scope().alias("industry"), F.lit(0).alias("late"), F.lit(None).cast("timestamp").alias("at"), F.col("pos").cast("long").alias("n"), F.trim("term").alias("term"))
    late = learned.select("term_type", scope().alias("industry"), F.lit(1).alias("late"), F.col("learned_at").alias("at"), F.lit(0).cast("long").alias("n"), F.trim("term").alias("term"))
    rows = early.unionByName(late).where((F.col("term") != "") & ((F.col("term_type") != "products") | (F.coalesce("industry", F.lit("")) != "")))
    order = ["late", "at", "n", "term"]
    once = dedupe.first_by(rows.withColumn("_low", F.lower("term")), ["term_type", "industry", "_low"], order)
    # A family's or an industry's list is what a person can keep in mind: small groups.
    return once.withColumn("pos", F.row_number().over(Window.partitionBy("term_type", "industry").orderBy(*order)) - 1).select("term_type", "industry", "pos", "term")


_PATTERNS = {name: re.compile(pattern, re.I if fold else 0) for name, (pattern, fold) in fixed.LEARNED_PATTERNS.items()}
_FOUND = ArrayType(StructType([StructField("term_type", StringType()), StructField("term", StringType())]))


def terms_of(text: str) -> list[tuple[str, str]]:
    """The terms of the three families in a text, family by family, each once whatever its case; none of over six words, with an @ or of the words refused."""
    out = []
    for family, pattern in _PATTERNS.items():
        seen: set[str] = set()
        for m in pattern.finditer(text):
            term = " ".join(m[0].strip(" .,:;-\t\r\n").split())
            low = term.casefold()
            if term and low not in seen and low not in fixed.REFUSED_TERMS and "@" not in term and len(term.split()) <= 6:
                seen.add(low)
                out.append((family, term))
    return out


@F.arrow_udf(_FOUND)
def _terms(texts: pa.Array) -> pa.Array:
    rows = [[{"term_type": f, "term": t} for f, t in terms_of(x or "")] for x in texts.to_pylist()]
    return pa.array(rows, pa.list_(pa.struct([("term_type", pa.string()), ("term", pa.string())])))


def learn(texts: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of LEARNED that texts(text, industry, source_url, at) teach beyond known(term).

    Texts come in the order of at, source and text.  Each teaches the first six of its terms
    that are neither known nor taught by one before; what is over is open to later texts.
    Texts of no web source teach nothing.  A term is known in any case and any family.
    Rounds decide: each lets every text take its six of what no earlier one took in the
    round before, until nothing changes; after n rounds the first n texts are settled, and
    as few texts hang on each other's, rounds are few.
    """
    web = texts.where(F.col("source_url").rlike("^https?://")).select("text", "industry", "source_url", F.col("at").alias("learned_at")).dropDuplicates(["text", "source_url", "learned_at"])
    by = F.struct("learned_at", "source_url", F.xxhash64("text"))
    rows = web.select("industry", "source_url", "learned_at", by.alias("_by"), F.posexplode(_terms(F.col("text"))).alias("pos", "t")).select("*", "t.term_type", "t.term", F.lower("t.term").alias("_low")).drop("t")
    # A term of two families counts in the first.
    rows = keep(dedupe.first_by(dedupe.exclude(rows, (known.select(F.lower("term").alias("_low")), "_low")), ["_by", "_low"], ["pos"]))
    taken = keep(rows.where("false"))
    while True:
        first = taken.groupBy("_low").agg(F.min("_by").alias("_first"))
        open_ = rows.join(first, "_low", "left").where(F.col("_first").isNull() | (F.col("_by") <= F.col("_first"))).drop("_first")
        new = keep(dedupe.within_quota(open_, ["_by"], ["pos"], MOST).select(rows.columns))
        if new.count() == taken.count() and new.join(taken, ["_by", "_low"], "left_anti").isEmpty():
            break
        taken = new
    return taken.select("term", "term_type", "industry", "source_url", "learned_at")


def teach(texts: DataFrame, base: DataFrame, folder: str) -> int:
    """Adds what texts teach to the learned terms of a folder, as a new version; keyed by the term in lower case, so that a rerun adds nothing."""
    spark = texts.sparkSession
    version = tables.versions(spark, folder)
    before = tables.read(spark, folder) if version else spark.createDataFrame([], f"{LEARNED}, key string")
    new = learn(texts, base.select("term").unionByName(before.select("term"))).withColumn("key", F.lower("term"))
    return tables.upsert(new, folder, ["key"])
