"""What the operators of this subpackage share: the shared folder, lineage cuts and small column helpers."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only where the session names none (a local test session) a temporary folder is
    made, set as the checkpoint folder, and removed when Python ends.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="recordweave-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(f"file://{own}")
    return f"file://{own}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder (a reliable checkpoint): lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fresh(df: DataFrame, parts: int | None = None) -> DataFrame:
    """cut(df), of which the planner knows no size; in at most so many partitions, as small frames need few files.

    A checkpoint keeps its plan's estimate, and a join's estimate is the product of both
    sides': in a loop its digits double each time, until the driver does nothing else.
    """
    spark, kept = df.sparkSession, cut(df.coalesce(parts) if parts else df)._jdf
    return DataFrame(spark._jsparkSession.createDataFrame(kept.javaRDD(), kept.schema()), spark)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of new_folder, through the file system that Spark writes with."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Returns freed memory to the system, as Python workers and the driver live on; nothing happens where the C library can't."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Bytes of an Arrow batch that the pipeline's tasks hold, in the JVM and in Python.
BATCH = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by BATCH bytes, unless it has a lower bound: 10,000 rows of long texts are far more."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(name).rstrip("b"))
    if not 0 < now <= BATCH:
        spark.conf.set(name, f"{BATCH}b")


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow; what it freed is given back at its end, as the worker waits on while others work."""

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return ended


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def crc_mod(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo modulus; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str) -> str:
    """The vocabulary file of that name: in the folder LLM_TOKENIZERS names, else where the installed package keeps it."""
    folder = os.environ.get("LLM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


#: log2 of the bits of a set of hashes: of fixed size, so that it can be broadcast; what it holds in excess costs work only.
SET_BITS = 26


def place_of(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(64 - SET_BITS)


def has_bit(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) != 0


def bit_set(rows: DataFrame, places: Callable[..., np.ndarray]) -> np.ndarray:
    """The set of places(*columns of rows), put together by Spark: however many rows, at most 2**(SET_BITS - 6) longs reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(places(*(c.to_numpy().view(np.uint64) for c in b.columns)))
            if len(at):
                word, first = np.unique(at >> np.uint64(6), return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first).view(np.int64))], ["word", "bits"])

    found = rows.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(1 << (SET_BITS - 6), np.uint64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return bits
