"""Monthly brew logs and daily weather as CSV."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from steepgrid.functions.columns import date_parts, lookup_or, normalise_weather, parse_day
from steepgrid.schemas import CANONICAL, DAILY_WEATHER, MONTHLY_LOG
from steepgrid.session import materialise

MISSING_PATH = {"PATH_NOT_FOUND"}

CORRUPT = "_corrupt_record"
REQUIRED = ("mesh", "gram", "extraction_time")  # what a brew must have besides its day
MONTH = r"(\d{4}_\d{2})"

# Order of a row among all logs; first-row-wins rules follow it.
FILE_ORDER = ["file_name", "block_start", "line"]


def read_monthly(spark: SparkSession, path_glob: str) -> DataFrame:
    """Every log file the glob matches in one scan, with its day parsed and its place kept.

    (file_name, block_start, line) is the order the rows stand in: line grows inside a block. ``problems`` names what a
    row lacks to be stored: ``row`` if it has too few or too many fields or a text for a number, otherwise the
    required columns that are empty or, for ``day``, no date. The parsed rows are written once: the parser looks
    only at the columns that a plan needs, so whether a row is sound would otherwise depend on who reads it.
    """
    raw = (
        spark.read.schema(T.StructType([*MONTHLY_LOG.fields, T.StructField(CORRUPT, T.StringType())]))
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(path_glob)
    )
    day = parse_day("Day")
    whole = F.col(CORRUPT).isNull()
    problems = [
        F.when(~whole, F.lit("row")),
        F.when(whole & day.isNull(), F.lit("day")),
        *[F.when(whole & F.col(c).isNull(), F.lit(c)) for c in REQUIRED],
    ]
    parsed = raw.select(
        *[f.name for f in MONTHLY_LOG],
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line"),
        day.alias("date"),
        F.array_compact(F.array(*problems)).alias("problems"),
    )
    return materialise(parsed, "logs")


def split_quarantine(logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of sound files, one row per bad file with its number of bad rows and their reasons).

    A file with any row that cannot be stored is set aside whole. Counting is a partial aggregate per file,
    so a single huge file never lands in one task.
    """
    bad_files = (
        logs.where(F.size("problems") > 0)
        .groupBy("file_path")
        .agg(
            F.count("*").alias("bad_rows"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("problems")))).alias("reasons"),
        )
    )
    return logs.join(bad_files, "file_path", "left_anti").drop("problems"), bad_files


class NoReadableLog(ValueError):
    """Every log file was set aside, or there was none."""


def require_rows(logs: DataFrame) -> DataFrame:
    """``logs`` unchanged, or an error when no readable file is left."""
    if logs.isEmpty():
        raise NoReadableLog("no readable monthly log was found")
    return logs


def with_file_tags(
    logs: DataFrame,
    tags: Mapping[str, tuple[str, str]],
    default: tuple[str, str],
) -> DataFrame:
    """Add year_month from the file's name or its folder's, and the bean and user that month is booked on.

    The mapping is a handful of literals, so it becomes a lookup expression and no join.
    """
    named = F.nullif(F.regexp_extract("file_name", MONTH, 1), F.lit(""))
    month = F.coalesce(named, F.regexp_extract("file_path", MONTH + r"[^/]*/[^/]*$", 1))
    beans = {key: bean for key, (bean, _) in tags.items()}
    users = {key: user for key, (_, user) in tags.items()}
    return logs.withColumn("year_month", month).withColumns(
        {
            "bean_name": lookup_or("year_month", beans, default[0]),
            "user_name": lookup_or("year_month", users, default[1]),
        }
    )


def canonical(logs: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The twelve brew columns in their fixed order, dates split and weather normalised."""
    weather = normalise_weather("Weather").alias("weather")
    return date_parts(logs).select(*[weather if c == "weather" else F.col(c) for c in [*CANONICAL, *extra]])


def concat_frames(*frames: DataFrame) -> DataFrame:
    """UNION ALL by column name."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first


def read_weather(spark: SparkSession, path: str, missing: str = "error") -> DataFrame:
    """Daily weather; ``missing='empty'`` gives an empty frame when the file is absent."""
    try:
        return spark.read.schema(DAILY_WEATHER).option("header", True).csv(path)
    except AnalysisException as error:
        if missing == "empty" and error.getCondition() in MISSING_PATH:
            return spark.createDataFrame([], DAILY_WEATHER)
        raise


def write_merged(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)

