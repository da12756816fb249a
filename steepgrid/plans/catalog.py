"""Registered queries: every one runs a library operator over whole tables, most beside the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from steepgrid.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the equivalent SQL where there is one."""

    def register(fn: Query) -> Query:
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, name, sf_dir)


def moment(df: DataFrame, col: str, text: str) -> Column:
    """A literal in the column's own type, so that the filter reaches the scan."""
    return F.lit(text).cast(df.schema[col].dataType)


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries and their SQL."""
    from steepgrid.plans import change_queries, ingest_queries, model_queries, read_queries  # noqa: F401

    return dict(QUERIES), dict(ORACLES)
