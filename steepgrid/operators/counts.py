"""Counts, totals and summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F


def table_count(df: DataFrame, alias: str = "row_count") -> DataFrame:
    return df.agg(F.count("*").alias(alias))


def labelled_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One (table_name, row_count) row per table."""
    parts = [table_count(df).select(F.lit(name).alias("table_name"), "row_count") for name, df in tables.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionAll(part)
    return result


def database_stats(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row with each table's count and their total."""
    counts = labelled_counts(tables)
    per_table = [
        F.sum(F.when(F.col("table_name") == name, F.col("row_count"))).alias(f"{name}_count") for name in tables
    ]
    return counts.agg(*per_table, F.sum("row_count").alias("total_records"))


def fact_counts(
    dims: DataFrame,
    facts: DataFrame,
    dim_key: str,
    fact_key: str,
    alias: str = "recipe_count",
    ordered: bool = False,
) -> DataFrame:
    """Dimension rows with their number of facts, zero included.

    Facts are counted per key before the join, so a hot key shrinks to one row per map task and
    the facts themselves never take part in the join.
    """
    counted = facts.where(F.col(fact_key).isNotNull()).groupBy(F.col(fact_key).alias("_key")).agg(F.count("*").alias("_n"))
    result = (
        dims.join(counted, dims[dim_key] == counted["_key"], "left")
        .withColumn(alias, F.coalesce("_n", F.lit(0)).cast("bigint"))
        .drop("_key", "_n")
    )
    return result.orderBy(F.desc(alias), dim_key) if ordered else result


def popular(
    dims: DataFrame,
    facts: DataFrame,
    dim_key: str,
    fact_key: str,
    k: int = 5,
    alias: str = "usage_count",
) -> DataFrame:
    """The k most used dimension rows."""
    return fact_counts(dims, facts, dim_key, fact_key, alias).orderBy(F.desc(alias), dim_key).limit(k)


def dataset_summary(
    df: DataFrame,
    date_col: str = "date",
    distinct: Mapping[str, str] | None = None,
    measures: Mapping[str, str] | None = None,
    digits: int = 1,
) -> DataFrame:
    """Rows, date range, distinct counts and measure ranges in one pass."""
    aggs = [
        F.count("*").alias("row_count"),
        F.min(date_col).alias("first_date"),
        F.max(date_col).alias("last_date"),
    ]
    for alias, col in (distinct or {}).items():
        aggs.append(F.countDistinct(col).alias(alias))
    for alias, col in (measures or {}).items():
        aggs.append(F.round(F.min(col), digits).alias(f"min_{alias}"))
        aggs.append(F.round(F.max(col), digits).alias(f"max_{alias}"))
    return df.agg(*aggs)


def owner_totals(
    owners: DataFrame,
    dims: DataFrame,
    facts: DataFrame,
    owner_key: str,
    dim_owner: str,
    dim_key: str,
    fact_key: str,
) -> DataFrame:
    """Number of own dimension rows and own facts for every owner, zero included.

    Both counts are aggregated before they meet the owners.
    """
    per_dim = fact_counts(dims.select(dim_key, dim_owner), facts, dim_key, fact_key, "_facts")
    per_owner = per_dim.groupBy(F.col(dim_owner).alias("_owner")).agg(
        F.count("*").alias("_dims"), F.sum("_facts").alias("_all")
    )
    return owners.join(per_owner, owners[owner_key] == per_owner["_owner"], "left").select(
        *[owners[c] for c in owners.columns],
        F.coalesce("_dims", F.lit(0)).cast("bigint").alias("bean_count"),
        F.coalesce("_all", F.lit(0)).cast("bigint").alias("recipe_count"),
    )


def flag_report(flagged: DataFrame, flag: str, yes: str = "inserted", no: str = "skipped") -> DataFrame:
    """How many rows carry the flag and how many do not."""
    return flagged.agg(
        F.coalesce(F.sum(F.when(F.col(flag), 1).otherwise(0)), F.lit(0)).cast("bigint").alias(yes),
        F.coalesce(F.sum(F.when(F.col(flag), 0).otherwise(1)), F.lit(0)).cast("bigint").alias(no),
    )


def group_sizes(df: DataFrame, keys: Sequence[str], alias: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(alias))
