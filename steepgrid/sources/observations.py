"""Weather service payloads stored as JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from steepgrid.functions.columns import (
    DEFAULT_HUMIDITY,
    DEFAULT_PRESSURE,
    DEFAULT_TEMPERATURE,
)
from steepgrid.schemas import OBSERVATION

DEFAULT_CATEGORY = "Clear"


def parse_observations(df: DataFrame, json_col: str) -> DataFrame:
    """Add temperature, humidity, pressure, category and description; NULL where the payload has none."""
    first = F.try_element_at(F.col("_obs.weather"), F.lit(1))
    return (
        df.withColumn("_obs", F.from_json(json_col, OBSERVATION))
        .withColumns(
            {
                "temperature": F.col("_obs.main.temp"),
                "humidity": F.col("_obs.main.humidity"),
                "pressure": F.col("_obs.main.pressure"),
                "category": first["main"],
                "description": first["description"],
            }
        )
        .drop("_obs")
    )


def observation_defaults(df: DataFrame) -> DataFrame:
    """Fill what the payload left out."""
    return df.withColumns(
        {
            "temperature": F.coalesce("temperature", F.lit(DEFAULT_TEMPERATURE)),
            "humidity": F.coalesce("humidity", F.lit(DEFAULT_HUMIDITY)),
            "pressure": F.coalesce("pressure", F.lit(DEFAULT_PRESSURE)),
            "category": F.coalesce("category", F.lit(DEFAULT_CATEGORY)),
            "description": F.coalesce("description", F.lit("")),
        }
    )
