"""Membership filters of bounded size and connected components, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from steepgrid.session import materialise

FILTER_BITS = 25


def probably_in(df: DataFrame, key: str, keys: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in the column of ``keys``, and a few that are not.

    The keys set bits of a map of 2 ** bits places, whatever their number, so at most 2 ** (bits - 6) rows
    are broadcast (8 MB by default). No row that belongs is lost; more keys only let more others
    through, and an exact join of the little that is left follows. Null keys do not pass.
    """

    def place(column: Column) -> Column:
        return F.xxhash64(column).bitwiseAND(F.lit((1 << bits) - 1))

    at = place(keys[keys.columns[0]])
    words = (
        keys.where(keys[keys.columns[0]].isNotNull())
        .select(at.alias("_at"))
        .groupBy(F.shiftright("_at", 6).alias("_word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(_at & 63 as int))")).alias("_set"))
    )
    return (
        df.where(F.col(key).isNotNull())
        .withColumn("_at", place(F.col(key)))
        .join(F.broadcast(words), F.shiftright("_at", 6) == F.col("_word"))
        .where(F.expr("getbit(_set, cast(_at & 63 as int)) = 1"))
        .select(*df.columns)
    )


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of the links' two columns; the label is the component's least node.

    Each round takes the least label among a node's neighbours, then that label's own label, so that a
    chain's length is at least halved; labels are written every round and counted by Spark.
    """
    a, b = links.columns
    edges = materialise(
        links.select(F.col(a).alias("x"), F.col(b).alias("y"))
        .unionByName(links.select(F.col(b).alias("x"), F.col(a).alias("y")))
        .where("x <> y")
        .distinct(),
        "edges",
    )
    labels = edges.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("near"))
    labels = materialise(labels.select("node", F.least("node", "near").alias("label")), "labels")
    while True:
        near = (
            edges.join(labels, edges["y"] == labels["node"])
            .groupBy("x")
            .agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, labels["node"] == near["x"]).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        lower = materialise(lower, "lower")
        up = lower.select(F.col("node").alias("up"), F.col("label").alias("up_label"))
        labels = materialise(
            lower.join(up, lower["label"] == up["up"], "left").select(
                "node", "old", F.least("label", F.coalesce("up_label", "label")).alias("label")
            ),
            "labels",
        )
        changed = labels.where("label <> old").limit(1).count()
        labels = labels.select("node", "label")
        if not changed:
            return labels
