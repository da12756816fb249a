"""Table readers and versioned table writers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

COMMITS = "_commits"


def read_table(
    spark: SparkSession,
    name: str,
    base: str | None = None,
    fmt: str = "parquet",
    **options: str,
) -> DataFrame:
    """One table by name: files under ``base``, a database table over JDBC, or a catalog table.

    A JDBC read of a large table should pass partitionColumn, lowerBound, upperBound and
    numPartitions, so that it is not pulled through one connection.
    """
    if fmt == "jdbc":
        return spark.read.format("jdbc").options(dbtable=name, **options).load()
    if base is None:
        return spark.table(name)
    suffix = ".parquet" if fmt == "parquet" and not base.rstrip("/").endswith(name) else ""
    return spark.read.format(fmt).options(**options).load(f"{base.rstrip('/')}/{name}{suffix}")


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder wherever the cluster keeps it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _committed(spark: SparkSession, base: str) -> dict[int, str]:
    """Version numbers and their folders. A commit is one small file, named by the version, that holds the folder's name."""
    fs, folder = _folder(spark, f"{base.rstrip('/')}/{COMMITS}")
    if not fs.exists(folder):
        return {}
    rows = spark.read.text(folder.toString()).select("value", "_metadata.file_name").collect()
    return {int(r["file_name"].removesuffix(".txt")): r["value"] for r in rows}


def latest_version(spark: SparkSession, base: str) -> int | None:
    return max(_committed(spark, base), default=None)


def read_version(spark: SparkSession, base: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{base.rstrip('/')}/{_committed(spark, base)[version]}")


def read_latest(spark: SparkSession, base: str) -> DataFrame:
    """The newest committed version of a table."""
    version = latest_version(spark, base)
    if version is None:
        raise FileNotFoundError(f"no finished version under {base}")
    return read_version(spark, base, version)


def write_version(df: DataFrame, base: str, after: int | None = None) -> int:
    """Write ``df`` as the next version, so a table can be derived from its own current state.

    ``after`` is the version that ``df`` was derived from (default: the newest one, 0 for a table not yet there). Rows are
    written to a folder of their own and count only once the commit file is there; creating it fails if somebody
    else has committed the same version, and then nothing has changed for readers.
    """
    spark, base = df.sparkSession, base.rstrip("/")
    version = (latest_version(spark, base) or 0 if after is None else after) + 1
    name = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{base}/{name}")
    fs, commit = _folder(spark, f"{base}/{COMMITS}/{version}.txt")
    if fs.exists(commit):
        raise FileExistsError(f"version {version} of {base} has been written by somebody else")
    stream = fs.create(commit, False)  # refuses an existing file
    stream.write(bytearray(name, "utf-8"))
    stream.close()
    return version


def append_rows(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Append a batch of rows in one committed job, by partition folders if asked for."""
    writer = df.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
