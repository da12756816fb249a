"""Row numbers for groups of any size, without a task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from steepgrid.session import materialise

# monotonically_increasing_id keeps the partition number above bit 33.
PARTITION_SHIFT = 33


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    alias: str = "row_number",
    size_alias: str = "group_size",
) -> DataFrame:
    """Add each row's 1-based position inside its group, and the group's size.

    A window per group would put a hot group into one task. Here rows are range-partitioned by
    (group, order, arrival), so a hot group, and even a hot order key, spreads over many tasks.
    Each task sorts its range; a position is the place inside the range plus the group's rows in
    earlier ranges, which are counted in a table of one row per (group, range). NULL order keys
    come first; full ties follow arrival order.
    """
    keys = [F.col(g) for g in group] + [F.col(o).asc_nulls_first() for o in order] + [F.col("_arrival")]
    ranged = (
        df.withColumn("_arrival", F.monotonically_increasing_id())
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .drop("_arrival")
        .withColumn("_place", F.monotonically_increasing_id())
    )
    placed = materialise(ranged, "ranges").withColumn(
        "_range", F.shiftrightunsigned("_place", PARTITION_SHIFT).cast("int")
    )
    names = [f"_g{i}" for i in range(len(group))]
    counted = placed.groupBy(
        *[F.col(g).alias(n) for g, n in zip(group, names)], F.col("_range").alias("_r")
    ).agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(*names)
    before = whole.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.withColumns(
        {
            "_before": F.coalesce(F.sum("_rows").over(before), F.lit(0)),
            size_alias: F.sum("_rows").over(whole),
        }
    )
    starts = materialise(starts, "starts")
    on = [placed["_range"] == starts["_r"]] + [placed[g].eqNullSafe(starts[n]) for g, n in zip(group, names)]
    return (
        placed.join(starts, on, "inner")
        .withColumn(alias, F.col("_place") - F.col("_first") + F.col("_before") + F.lit(1))
        .select(*df.columns, alias, size_alias)
    )


def assign_ids(rows: DataFrame, table: DataFrame, id_col: str, order: Sequence[str]) -> DataFrame:
    """Number new rows on from the table's largest id."""
    numbered = number_rows(rows, [], order, "_n", "_size")
    top = table.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("top"))
    kind = table.schema[id_col].dataType
    return numbered.withColumn(id_col, (top.scalar() + F.col("_n")).cast(kind)).drop("_n", "_size")
