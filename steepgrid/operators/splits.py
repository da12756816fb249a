"""Reproducible train/test and fold splits per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from steepgrid.operators.ranks import number_rows


def assign_folds(
    df: DataFrame, group: Sequence[str], order: Sequence[str], k: int = 3, alias: str = "fold"
) -> DataFrame:
    """Unshuffled folds 1..k: contiguous in ``order``, the first n mod k folds one row larger."""
    numbered = number_rows(df, group, order, "_rn", "_n")
    return numbered.withColumn(alias, fold_at(F.col("_rn") - 1, F.col("_n"), k)).drop("_rn", "_n")


def fold_at(place: Column, n: Column, k: int) -> Column:
    """Fold 1..k of the row at a 0-based place among n rows."""
    short, longer = F.floor(n / F.lit(k)), n % F.lit(k)
    head = longer * (short + 1)
    fold = F.when(place < head, F.floor(place / (short + 1))).otherwise(
        longer + F.floor((place - head) / F.greatest(short, F.lit(1)))
    )
    return (fold + 1).cast("int")


def holdout_split(
    df: DataFrame,
    group: Sequence[str],
    key: Sequence[str],
    frac: float = 0.1,
    seed: int = 42,
    alias: str = "is_test",
    size_alias: str = "group_size",
) -> DataFrame:
    """Seeded split with ceil(frac * n) test rows per group, in the order of a keyed digest.

    The key must identify a row. Its text with the seed gives the digest, so the split depends on
    the rows alone and not on how they are laid out.
    """
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in key])
    digested = df.withColumn("_digest", F.md5(F.concat(text, F.lit(f":{seed}"))))
    numbered = number_rows(digested, group, ["_digest", *key], "_rn", size_alias)
    return numbered.withColumn(alias, F.col("_rn") <= F.ceil(F.lit(frac) * F.col(size_alias))).drop("_rn", "_digest")
