"""Tables that are replaced as a whole, kept as versions: readers see the old one or the new one, never a part."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DRY_RUN = "_DRY_RUN"


def _listed(spark: SparkSession, folder: str) -> dict[int, bool]:
    """The versions in a folder, and whether each was written to its end."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    path = hadoop(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return {int(n[2:]): fs.exists(hadoop(f"{folder}/{n}/_SUCCESS")) for n in names if n.startswith("v=")}


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The complete versions, oldest first."""
    return sorted(v for v, whole in _listed(spark, folder).items() if whole)


def _at(folder: str, version: int) -> str:
    return f"{folder}/v={version:08d}"


def _claim(spark: SparkSession, folder: str) -> int:
    """The next version's number, for this writer alone: whoever makes the number's claim file has it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    claims = hadoop(f"{folder}/_claims")
    fs = claims.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(claims)
    claimed = [int(s.getPath().getName()) for s in fs.listStatus(claims) if s.getPath().getName().isdigit()]
    new = max([*_listed(spark, folder), *claimed], default=0) + 1
    while not _create(spark, fs, hadoop(f"{folder}/_claims/{new:08d}")):
        new += 1
    return new


def _create(spark: SparkSession, fs, path) -> bool:
    """Makes an empty file if there is none, in one step; False if another has made it."""
    if fs.getUri().getScheme() == "file":
        return spark.sparkContext._jvm.java.io.File(path.toUri().getPath()).createNewFile()
    try:
        fs.create(path, False).close()
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def replace(df: DataFrame, folder: str, dry_run: bool = False, partition: str | None = None) -> int:
    """Writes df as the folder's next version and returns its number; df may read the version before.

    A dry run writes beside the folder instead.  A number is claimed before anything is
    written: two writers at once get two numbers and never mix.  Of two such versions the
    higher is the last one, also where the lower is complete later.  Versions and claims
    that a lost writer left are passed over.
    """
    folder = folder.rstrip("/") + (DRY_RUN if dry_run else "")
    new = _claim(df.sparkSession, folder)
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(partition) if partition else writer).parquet(_at(folder, new))
    return new


def every(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all complete versions, of a folder whose versions add to each other; columns a version lacks are null."""
    frames = [spark.read.parquet(_at(folder, v)) for v in versions(spark, folder)]
    if not frames:
        raise FileNotFoundError(f"{folder} has no version")
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def ensure(spark: SparkSession, folder: str, columns: dict[str, Column]) -> int:
    """The version that has these columns: the last one if it has, else a new one with the missing ones added.

    Columns are only added, in the order given; what a missing one holds may be computed of
    the row.  An empty folder becomes a table without rows, of columns that need no row.
    """
    known = versions(spark, folder)
    table = read(spark, folder) if known else spark.range(0).select()
    missing = {name: value for name, value in columns.items() if name not in table.columns}
    if known and not missing:
        return known[-1]
    return replace(table.select(*table.columns, *(value.alias(name) for name, value in missing.items())), folder)


def upsert(rows: DataFrame, folder: str, keys: list[str], dry_run: bool = False) -> int:
    """A new version in which rows take the place of those with equal keys, and others are added.

    Null keys are equal to each other.  Columns that either side lacks are null there.  Of
    rows with equal keys any one is taken: keys should tell rows apart.
    """
    rows = rows.dropDuplicates(keys)
    spark = rows.sparkSession
    if not versions(spark, folder):
        return replace(rows, folder, dry_run)
    old = read(spark, folder).alias("o")
    new = rows.select(*(F.col(k).alias(f"_{k}") for k in keys)).alias("n")
    same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n._{k}")) for k in keys]
    match = same[0]
    for s in same[1:]:
        match = match & s
    return replace(old.join(new, match, "left_anti").unionByName(rows, allowMissingColumns=True), folder, dry_run)


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The last complete version, or the one named."""
    known = versions(spark, folder)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"{folder} has no such version")
    return spark.read.parquet(_at(folder, version or known[-1]))


def append(df: DataFrame, folder: str) -> None:
    """Adds rows to a log that only grows; a failed write adds none."""
    df.write.mode("append").parquet(folder)
