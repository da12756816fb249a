"""Regression metrics per group over frames of (group, target, prediction)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from steepgrid.functions.columns import within
from steepgrid.functions.scores import r2_from_sums


def _mean(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols) / F.lit(float(len(cols)))


def r2(df: DataFrame, group: Sequence[str], pairs: Mapping[str, str], alias: str = "r2") -> DataFrame:
    """R² of every target (column -> prediction column) and their plain mean, in one aggregation.

    Sums are taken around the group's own sums only, so partial results merge on the map side.
    """
    aggs = [F.count("*").alias("n")]
    for y, predicted in pairs.items():
        error = F.col(y) - F.col(predicted)
        aggs += [
            F.sum(y).alias(f"_s_{y}"),
            F.sum(F.col(y) * F.col(y)).alias(f"_ss_{y}"),
            F.sum(error * error).alias(f"_e_{y}"),
        ]
    sums = df.groupBy(*group).agg(*aggs)
    scores = {
        y: r2_from_sums(F.col("n"), F.col(f"_s_{y}"), F.col(f"_ss_{y}"), F.col(f"_e_{y}")) for y in pairs
    }
    return sums.select(
        *group, "n", *[score.alias(f"{alias}_{y}") for y, score in scores.items()], _mean(list(scores.values())).alias(alias)
    )


def tolerance_accuracy(
    df: DataFrame, group: Sequence[str], pairs: Mapping[str, str], tolerances: Mapping[str, float]
) -> DataFrame:
    """Share of rows inside the tolerance, per target and for all targets at once."""
    hits = {y: within(y, predicted, tolerances[y]) for y, predicted in pairs.items()}
    every = reduce(lambda a, b: a * b, hits.values())
    return df.groupBy(*group).agg(
        F.count("*").alias("n_eval"),
        *[F.avg(hit).alias(f"acc_{y}") for y, hit in hits.items()],
        F.avg(every).alias("acc_overall"),
    )


def fold_stats(df: DataFrame, group: Sequence[str], score: str = "r2") -> DataFrame:
    """Mean and population deviation of the fold scores."""
    return df.groupBy(*group).agg(
        F.avg(score).alias("fold_mean"), F.stddev_pop(score).alias("fold_std"), F.count("*").alias("folds")
    )


def array_std(values: Column | str) -> Column:
    """Population deviation of an array of numbers."""
    values = F.col(values) if isinstance(values, str) else values
    n = F.size(values).cast("double")
    mean = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x) / n
    squares = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
    return F.sqrt(squares / n)


def mean_tree_std(df: DataFrame, group: Sequence[str], trees: Mapping[str, str], alias: str = "mean_std") -> DataFrame:
    """Mean over rows and targets of the deviation between the trees; target -> array column of tree values."""
    per_row = _mean([array_std(col) for col in trees.values()])
    return df.groupBy(*group).agg(F.avg(per_row).alias(alias))
