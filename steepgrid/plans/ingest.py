"""CSV ingest: read, normalise, join the weather, fill, and append what is new."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from steepgrid.functions.columns import collated, fill_weather, round_int
from steepgrid.operators.changes import (
    append_new,
    append_report,
    duplicate_rate,
    gate_open,
    ids_by_name,
    resolve_dim,
    table_slice,
)
from steepgrid.operators.counts import dataset_summary
from steepgrid.operators.ranks import assign_ids
from steepgrid.operators.reads import join_weather
from steepgrid.schemas import CANONICAL, IDEMPOTENCE_KEY, INSERT_COLUMNS, RECIPE
from steepgrid.session import materialise
from steepgrid.sources.logs import (
    FILE_ORDER,
    canonical,
    read_monthly,
    read_weather,
    require_rows,
    split_quarantine,
    with_file_tags,
)
from steepgrid.sources.tables import append_rows

MERGED_COLUMNS = [*CANONICAL, "temperature", "humidity"]


@dataclass
class IngestResult:
    """``inserted`` is what was appended; ``report`` counts it; the rest explains what was not."""

    inserted: DataFrame
    report: DataFrame
    duplicates: DataFrame
    unknown_names: DataFrame
    summary: DataFrame


def merge_logs(
    spark: SparkSession,
    logs_glob: str,
    weather_path: str,
    tags: Mapping[str, tuple[str, str]],
    default: tuple[str, str],
    missing_weather: str = "empty",
) -> tuple[DataFrame, DataFrame]:
    """(merged brews with their place in the files, bad files)."""
    logs, bad_files = split_quarantine(read_monthly(spark, logs_glob))
    brews = canonical(with_file_tags(require_rows(logs), tags, default), FILE_ORDER)
    merged = fill_weather(join_weather(brews, read_weather(spark, weather_path, missing_weather)))
    return merged.select(*MERGED_COLUMNS, *FILE_ORDER), bad_files


def recipe_types(rows: DataFrame) -> DataFrame:
    """Merged measures in the types the recipe table stores, so that keys compare equal."""
    return rows.withColumns(
        {
            "humidity": round_int("humidity"),
            **{c: F.col(c).cast("float") for c in ("temperature", "gram", "mesh", "extraction_time", "days_passed")},
        }
    )


def ingest(
    spark: SparkSession,
    merged: DataFrame,
    beans: DataFrame,
    recipe_path: str,
    keys: list[str] = IDEMPOTENCE_KEY,
    collation: str | None = None,
    partition: str | None = None,
) -> IngestResult:
    """Append the merged brews that the recipe table does not hold yet.

    The merged rows and the rows to insert are each written once and reused. Running the same
    logs again inserts nothing. ``collation`` decides which bean names are the same; ``partition``
    is the column a partitioned recipe table is laid out by, and then only the batch's partitions are compared.
    """
    recipe = spark.read.schema(RECIPE).parquet(recipe_path)
    batch = materialise(recipe_types(merged), "merged")
    stored = recipe if partition is None else table_slice(recipe, batch, partition)
    rows = append_new(batch, stored, beans, keys, FILE_ORDER, "bean_name", "name", "id", collation=collation)
    inserted = materialise(
        assign_ids(rows.select(*INSERT_COLUMNS, *FILE_ORDER), recipe, "id", FILE_ORDER).select(
            *[F.col(f.name).cast(f.dataType) for f in RECIPE]
        ),
        "inserted",
    )
    known, unknown = resolve_dim(batch, beans, "bean_name", "name", "id", collation=collation)
    ids = ids_by_name(beans, "name", "id", collation=collation)
    named = batch.join(ids, collated("bean_name", collation) == F.col("_name"), "left").drop("_name")
    duplicates = materialise(duplicate_rate(named, stored, keys), "duplicates")
    report = materialise(append_report(known, stored, keys, gate_open(duplicates)), "report")
    append_rows(inserted, recipe_path, partition)
    return IngestResult(
        inserted,
        report,
        duplicates,
        unknown.select("bean_name").distinct(),
        dataset_summary(
            batch,
            distinct={"bean_names": "bean_name", "user_names": "user_name"},
            measures={"temperature": "temperature", "humidity": "humidity"},
        ),
    )
