"""A corpus from raw documents: language, near duplicates, personal data, packing.

Every stage works on all rows the one before it kept, as written to the shared folder; all
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordweave.llm import langid, packing, pii, shingles, simhash
from recordweave.llm.common import crc_mod, new_folder, remove, small_batches, tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that have a letter and whose leading language is likely and familiar enough.

    The least score and familiarity are fitted on labelled documents that the model didn't
    see (crc32(doc_id as text) mod 3 is 1); labels are not inputs of a decision.  Without
    labels both are 0 and only texts without a letter go.  Null and empty texts go; equal
    texts share their fate, however often they come; null and repeated doc_ids are rows
    like any other; an empty table gives no rows; all columns stay, whatever their names.
    """
    small_batches(spark)
    model, least = langid.learn(docs.select("text", "lang", (crc_mod(F.col("doc_id"), 3) == 1).alias("held")))
    # The prediction is made in the row's own task, so no document moves for it.
    return langid.keep(docs, model, least)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard of five-word shingles 0.8 or more, linked) stays: that with the smallest doc_id.

    SimHash fingerprints of that width propose pairs through the Gray-order index; as such
    pairs may differ in more bits than an index can route by, a prefix filter finds the
    others, and the shingle sets decide on all.  Null texts count as empty; texts without
    words are one group.  Rows of a null doc_id stay.  Of rows of one doc_id with different
    texts each is in its own text's group; equal rows stay once.  An empty table gives no
    rows; all columns stay, whatever their names.
    """
    small_batches(spark)
    return simhash.first_of(docs, shingles.near_copies(docs, width=5), shingles.with_words_key)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their personal data replaced by its kind; n_chars is counted anew.

    A null text stays null, and its n_chars becomes null; ids, repeated rows, other columns
    and empty tables as in pii.redact.
    """
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences of 1024 tokens, by document, with a digest of their ids.

    The sequences themselves, put together from pieces and boundary records, are written to
    the shared folder as packed-*, the corpus that the pipeline makes.  Null texts, repeated
    rows, empty tables and other columns as in packing.concat_and_cut.
    """
    small_batches(spark)
    folder = new_folder(spark, "pieces")
    packing.concat_and_cut(docs, tokenizer_path("byte_bpe_50k.json"), length=1024).write.parquet(folder)
    pieces = spark.read.parquet(folder)
    packing.sequences(pieces, length=1024).write.parquet(new_folder(spark, "packed"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("redact_pii", redact_pii), ("pack", pack)]
#: None of the stages can be expressed in SQL; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, after each stage has been written and read again.

    What a stage read is removed once its result is written; the last result and the packed
    sequences stay.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        folder = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            remove(spark, before)
        before = folder
    return docs
