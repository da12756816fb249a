"""Feature lists, alignment of rows to a stored list, and the training gate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from steepgrid.functions.columns import (
    DEFAULT_HUMIDITY,
    DEFAULT_TEMPERATURE,
    date_parts,
    default_days,
    fill_weather,
)
from steepgrid.operators.counts import fact_counts
from steepgrid.schemas import BASE_FEATURES
from steepgrid.session import materialise

MIN_TRAINING_ROWS = 10


def base_features(
    df: DataFrame,
    date_col: str = "date",
    temperature: float = DEFAULT_TEMPERATURE,
    humidity: float = DEFAULT_HUMIDITY,
) -> DataFrame:
    """Add the numeric features: date parts, and measurements with their defaults."""
    filled = fill_weather(date_parts(df, date_col), temperature, humidity)
    return filled.withColumn("days_passed", default_days("days_passed"))


def one_hot(df: DataFrame, col: str, prefix: str, categories: Sequence[str]) -> DataFrame:
    """0/1 columns for a stated category list; unseen values and NULL are all zero."""
    return df.withColumns(
        {f"{prefix}_{c}": F.when(F.col(col) == c, 1).otherwise(0) for c in categories}
    )


def _prefixed(values: str, prefix: str) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(f"{prefix}_"), v))


def feature_lists(
    df: DataFrame,
    group: Sequence[str],
    categories: Mapping[str, str],
    base: Sequence[str] = BASE_FEATURES,
    alias: str = "feature_names",
    count_alias: str = "sample_count",
) -> DataFrame:
    """Row count and feature names of every group: the numeric ones, then prefix_value for each category it has seen.

    Only distinct (group, value) pairs are gathered, so the size of a group does not matter.
    """
    sets = df.groupBy(*group).agg(
        F.count("*").alias(count_alias),
        *[F.sort_array(F.collect_set(c)).alias(f"_set_{c}") for c in categories]
    )
    names = [F.array(*[F.lit(b) for b in base])]
    for c, prefix in categories.items():
        names.append(_prefixed(f"_set_{c}", prefix))
    return sets.select(*group, count_alias, F.concat(*names).alias(alias))


def encode(
    df: DataFrame,
    lists: DataFrame,
    group: Sequence[str],
    categories: Mapping[str, str],
    base: Sequence[str] = BASE_FEATURES,
    names: str = "feature_names",
    alias: str = "features",
    ones: str = "ones",
) -> DataFrame:
    """Add the row's numbers, and for each category the place of its name in the group's stored list.

    ``alias`` holds the numeric features and ``ones`` one entry per category: the place of ``prefix_value`` in the list,
    -1 where the value is unknown to the group or NULL. Places are found by a join on (group, name), so a
    row costs the same however long the list is, and the list is nobody's array. Rows of groups without a list drop out.
    """
    places = lists.select(*group, F.posexplode(names).alias("_place", "_name")).where(F.col("_place") >= len(base))
    out = df.join(lists.select(*group), list(group), "inner")
    for i, (column, prefix) in enumerate(categories.items()):
        own = places.where(F.col("_name").startswith(f"{prefix}_")).select(
            *group, F.col("_name").alias(f"_n{i}"), F.col("_place").alias(f"_p{i}")
        )
        named = out.withColumn(f"_n{i}", F.concat(F.lit(f"{prefix}_"), column))
        out = named.join(own, [*group, f"_n{i}"], "left").drop(f"_n{i}")
    found = [F.coalesce(F.col(f"_p{i}"), F.lit(-1)) for i in range(len(categories))]
    numbers = F.array(*[F.col(b).cast("double") for b in base])
    return out.withColumns({alias: numbers, ones: F.array(*found).cast("array<int>")}).drop(
        *[f"_p{i}" for i in range(len(categories))]
    )


def align(
    df: DataFrame,
    lists: DataFrame,
    group: Sequence[str],
    categories: Mapping[str, str],
    base: Sequence[str] = BASE_FEATURES,
    names: str = "feature_names",
    alias: str = "features",
    how: str = "inner",
) -> DataFrame:
    """Add the row's values in the order of its group's stored list: absent names 0, unknown values dropped.

    This is the dense form, as long as the list; models take ``encode``. A stored list holds the numeric names first, then the trained names of each category in turn.
    """
    parts = {
        f"_names_{c}": F.filter(names, _starts_with(f"{prefix}_")) for c, prefix in categories.items()
    }
    split = lists.select(*group, *[part.alias(p) for p, part in parts.items()])
    joined = df.join(split, list(group), how)
    numbers = F.array(*[F.col(b).cast("double") for b in base])
    dummies = [_indicator(f"_names_{c}", F.concat(F.lit(f"{prefix}_"), c)) for c, prefix in categories.items()]
    return joined.withColumn(alias, F.concat(numbers, *dummies)).drop(*parts)


def _starts_with(prefix: str):
    return lambda name: name.startswith(prefix)


def _indicator(names: str, name: Column) -> Column:
    """Zeros as long as ``names`` with a one where ``name`` stands; built-in array functions keep it compiled."""
    size = F.size(names)
    place = F.coalesce(F.array_position(names, name), F.lit(0)).cast("int")
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    return F.when(place == 0, zeros(size)).otherwise(
        F.concat(zeros(place - 1), F.array(F.lit(1.0)), zeros(size - place))
    )


def training_gate(
    dims: DataFrame,
    facts: DataFrame,
    dim_key: str,
    fact_key: str,
    minimum: int = MIN_TRAINING_ROWS,
) -> DataFrame:
    """Per dimension row: its number of training rows and no_data, too_few or ok."""
    counted = fact_counts(dims, facts, dim_key, fact_key, "sample_count")
    n = F.col("sample_count")
    return counted.withColumn(
        "status", F.when(n == 0, "no_data").when(n < minimum, "too_few").otherwise("ok")
    )


def trainable(df: DataFrame, group: Sequence[str], minimum: int = MIN_TRAINING_ROWS) -> DataFrame:
    """Rows of groups that pass the gate.

    The passing groups are written first, so their exact size decides how they are joined and a
    short list leaves the rows unshuffled.
    """
    enough = df.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") >= minimum).drop("_n")
    return df.join(materialise(enough, "trainable"), list(group), "left_semi")
