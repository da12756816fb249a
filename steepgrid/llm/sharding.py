"""Contiguous shards of near equal bytes, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from steepgrid.session import materialise

PARTITION_SHIFT = 33  # monotonically_increasing_id keeps the partition number above bit 33
ROW_OVERHEAD = 8


def shard_by_bytes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 24,
    whole_share: float = 0.04,
) -> DataFrame:
    """Cut the documents, in one global order, into contiguous shards of near equal size.

    A row's size is the UTF-8 length of its text plus 8. Rows are range-partitioned by (text digest, id),
    so equal texts stand together; each partition's total goes into a prefix sum over partitions, and
    a row's start is that prefix plus the sizes before it in its partition. A row goes to the shard in
    which its middle lies. A group of equal texts of at most ``whole_share`` of a shard goes by the
    group's middle and so stays whole; a larger one is cut by rows, since a shard could not hold it
    and stay near equal. Texts themselves are never shuffled.

    Returns ``id_col, size, text_crc32, law, shard, slot, grown_shard``. Null text counts as empty;
    null ids are ordinary ids and sort first; repeated rows are kept, each with its own slot; an empty
    table gives an empty result; other columns of ``docs`` are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("_size"),
        F.crc32(text.cast("binary")).alias("_crc"),
        F.xxhash64(text).alias("_digest"),
    )
    order = [F.col("_digest"), F.col("_crc"), F.col("_size"), F.col("_id").asc_nulls_first()]
    placed = materialise(
        keyed.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id()),
        "shard-order",
    ).withColumn("_range", F.shiftrightunsigned("_place", PARTITION_SHIFT).cast("int"))

    totals = placed.groupBy("_range").agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_rows"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    prefix = materialise(
        totals.select(  # one row per partition
            F.col("_range").alias("_r"),
            F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_bytes_before"),
            F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        ),
        "shard-prefix",
    )
    total = totals.agg(F.coalesce(F.sum("_bytes"), F.lit(1)).alias("total")).first()["total"]

    inside = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    started = materialise(
        placed.join(prefix, placed["_range"] == prefix["_r"]).select(
            "_id",
            "_size",
            "_crc",
            "_digest",
            (F.col("_bytes_before") + F.coalesce(F.sum("_size").over(inside), F.lit(0))).alias("_start"),
            (F.col("_rows_before") + F.coalesce(F.count("*").over(inside), F.lit(0))).alias("_row"),
        ),
        "shard-starts",
    )
    limit = int(total / shards * whole_share)
    whole = (
        started.groupBy(F.col("_digest").alias("_d"), F.col("_crc").alias("_c"), F.col("_size").alias("_s"))
        .agg(F.sum("_size").alias("_group"), F.min("_start").alias("_group_start"), F.count("*").alias("_n"))
        .where((F.col("_n") > 1) & (F.col("_group") <= limit))
    )
    same = (F.col("_digest") == F.col("_d")) & (F.col("_crc") == F.col("_c")) & (F.col("_size") == F.col("_s"))
    twice_middle = F.coalesce(2 * F.col("_group_start") + F.col("_group"), 2 * F.col("_start") + F.col("_size"))
    cut = started.join(whole, same, "left").select(
        "_id",
        "_size",
        "_crc",
        "_row",
        twice_middle.alias("_middle"),
    )
    cut = materialise(
        cut.withColumn("_shard", F.least(F.lit(shards - 1), F.expr(f"(_middle * {shards}L) div {2 * total}L")).cast("int")),
        "shard-cuts",
    )
    first = cut.groupBy(F.col("_shard").alias("_k")).agg(F.min("_row").alias("_first"))  # a row per shard
    return cut.join(F.broadcast(first), F.col("_shard") == F.col("_k")).select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        (F.col("_row") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
