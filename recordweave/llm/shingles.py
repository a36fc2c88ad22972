"""The pipeline's near copies: the Jaccard join, after what SimHash proposes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordweave.llm import jaccard
from recordweave.llm.simhash import with_key


def near_copies(docs: DataFrame, width: int = 5, least: tuple[int, int] = jaccard.LEAST, bits: int = 4) -> DataFrame:
    """doc_id, key, component, component_id as first_of takes them, for each row of docs with a doc_id.

    Links are those of jaccard.near_copies; texts without words are one group of their own, with key 0.
    """
    found = jaccard.near_copies(docs.where("doc_id is not null"), width, least, bits)
    keyed = found.select("doc_id", F.coalesce("node", F.lit(0)).alias("key"), F.coalesce("component", F.lit(0)).alias("component"))
    smallest = keyed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return keyed.join(smallest, "component").select("doc_id", "key", "component", "component_id")


def with_words_key(rows: DataFrame, width: int = 5) -> DataFrame:
    """rows with the column _key: the key of near_copies."""
    shingles = jaccard.Shingles(width)

    def key(text: str) -> int:
        s = shingles.set(text)
        return jaccard.digest(s) if len(s) else 0

    return with_key(rows, key)
