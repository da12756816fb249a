"""Changes to a table laid out in partition folders: only the folders that hold a changed row are rewritten."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from steepgrid.operators import changes as whole
from steepgrid.session import materialise


def store_partitioned(df: DataFrame, path: str, partition: str) -> None:
    """A table in one folder per value of ``partition``; rows of a value meet before they are written, so files stay few."""
    df.repartition(partition).write.partitionBy(partition).parquet(path)


def rewrite_partitions(
    spark: SparkSession, path: str, partition: str, touched: DataFrame, change: Callable[[DataFrame], DataFrame]
) -> list:
    """Apply ``change`` to the rows of the touched partitions and put the result in their place.

    ``touched`` has the partitions' values, of every partition that ``change`` takes rows from or puts rows into; they are
    listed by the driver like the folders they stand for. The new rows are written to the scratch folder first, as the
    table cannot be overwritten while it is read. A partition that ``change`` empties keeps its folder with an
    empty file. Returns the touched values.
    """
    values = sorted(r[0] for r in touched.select(partition).where(F.col(partition).isNotNull()).distinct().collect())
    if not values:
        return []
    stored = spark.read.parquet(path)
    kind = stored.schema[partition].dataType
    inside = stored.where(F.col(partition).isin([F.lit(v).cast(kind) for v in values]))
    new = materialise(change(inside).select(*stored.columns), "changed-partitions")
    before = {r[0] for r in inside.select(partition).distinct().collect()}
    left = {r[0] for r in new.select(partition).distinct().collect()}
    if left:
        (
            new.repartition(partition)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(partition)
            .parquet(path)
        )
    # An overwrite by partition leaves alone what gets no row.
    for value in sorted(before - left):
        new.drop(partition).limit(0).write.mode("overwrite").parquet(f"{path}/{partition}={value}")
    return values


def _partitions_of(spark: SparkSession, path: str, keys: DataFrame, key: str, partition: str) -> DataFrame:
    stored = spark.read.parquet(path).select(key, partition)
    return stored.join(keys.select(key).distinct(), key, "left_semi").select(partition)


def update_partitions(
    spark: SparkSession,
    path: str,
    partition: str,
    changes: DataFrame,
    key: str,
    cols: Sequence[str],
    order: Sequence[str] = (),
) -> list:
    """``changes.update_rows`` on the folders that hold a named row; an updated ``partition`` moves the row there."""
    latest = materialise(whole.last_per_key(changes, [key], order) if order else changes, "latest-changes")
    touched = _partitions_of(spark, path, latest, key, partition)
    if partition in cols:
        known = spark.read.parquet(path).select(key)
        touched = touched.union(latest.join(known, key, "left_semi").select(partition))
    return rewrite_partitions(spark, path, partition, touched, lambda rows: whole.update_rows(rows, latest, key, cols))


def upsert_partitions(spark: SparkSession, path: str, partition: str, changes: DataFrame, key: str) -> list:
    """``changes.upsert`` on the folders that hold a replaced row or get a new one."""
    latest = materialise(changes, "latest-changes")
    touched = _partitions_of(spark, path, latest, key, partition).union(latest.select(partition))
    return rewrite_partitions(spark, path, partition, touched, lambda rows: whole.upsert(rows, latest, key))


def delete_partitions(spark: SparkSession, path: str, partition: str, ids: DataFrame, key: str) -> list:
    """``changes.delete_rows`` on the folders that hold a named row."""
    gone = materialise(ids.select(key).distinct(), "deleted-keys")
    touched = _partitions_of(spark, path, gone, key, partition)
    return rewrite_partitions(spark, path, partition, touched, lambda rows: whole.delete_rows(rows, gone, key))
