"""Scalar rules: parsing, normalisation, defaults, rounding, validation, display."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

# Weather words of the log files and what they are stored as.
LOG_WEATHER = {
    "晴": "晴れ",
    "くもり": "曇り",
    "雨": "雨",
    "くもり/雨": "雨",
    "雪": "雪",
}
LOG_WEATHER_DEFAULT = "晴れ"

# Weather service categories and what they are stored as.
API_WEATHER = {
    "Clear": "晴れ",
    "Clouds": "曇り",
    "Rain": "雨",
    "Snow": "雪",
    "Thunderstorm": "雨",
    "Drizzle": "雨",
    "Mist": "曇り",
    "Fog": "曇り",
}
API_WEATHER_DEFAULT = "晴れ"

# Defaults for missing measurements.
DEFAULT_TEMPERATURE = 20.0
DEFAULT_HUMIDITY = 60.0
DEFAULT_PRESSURE = 1013.25
DEFAULT_DAYS_PASSED = 15.0
DEFAULT_ORIGIN = "その他"
DEFAULT_ROLE = "ROLE_USER"

DAY_FORMAT = "yyyy年M月d日"
EMAIL_PATTERN = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
MAX_NAME_LENGTH = 50
MIN_PASSWORD_LENGTH = 6


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup_or(c: Column | str, mapping: Mapping[str, str], default: str) -> Column:
    """Value of ``mapping`` for ``c``; ``default`` for unknown or NULL."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.coalesce(F.try_element_at(table, _col(c)), F.lit(default))


def parse_day(c: Column | str, fmt: str = DAY_FORMAT) -> Column:
    """Date of a log's day text; NULL when it does not parse."""
    return F.try_to_date(_col(c), fmt)


def date_parts(df: DataFrame, c: str = "date") -> DataFrame:
    """Add year, month, day and day_of_week (Monday = 0)."""
    return df.withColumns(
        {
            "year": F.year(c),
            "month": F.month(c),
            "day": F.day(c),
            "day_of_week": F.weekday(c),
        }
    )


def normalise_weather(c: Column | str) -> Column:
    return lookup_or(c, LOG_WEATHER, LOG_WEATHER_DEFAULT)


def map_api_weather(c: Column | str) -> Column:
    return lookup_or(c, API_WEATHER, API_WEATHER_DEFAULT)


def fill_weather(
    df: DataFrame,
    temperature: float = DEFAULT_TEMPERATURE,
    humidity: float = DEFAULT_HUMIDITY,
    temperature_col: str = "temperature",
    humidity_col: str = "humidity",
) -> DataFrame:
    return df.withColumns(
        {
            temperature_col: F.coalesce(temperature_col, F.lit(temperature)),
            humidity_col: F.coalesce(humidity_col, F.lit(humidity)),
        }
    )


def zero_nulls(df: DataFrame, cols: list[str]) -> DataFrame:
    """Read NULL numerics as 0."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in cols})


def round_int(c: Column | str) -> Column:
    """Nearest integer, halves away from zero; a bare cast would truncate."""
    return F.round(_col(c)).cast("int")


def default_days(c: Column | str, default: float = DEFAULT_DAYS_PASSED) -> Column:
    return F.coalesce(_col(c), F.lit(default))


def default_role(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(DEFAULT_ROLE))


def round_half_up(c: Column | str, digits: int = 0) -> Column:
    """Round with halves towards plus infinity: -0.25 gives -0.2 at one digit."""
    scale = float(10**digits)
    return F.floor(_col(c) * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def to_number(c: Column | str, kind: str = "double") -> Column:
    """Text as a number, NULL when it is not one."""
    return F.trim(_col(c)).try_cast(kind)


def safe_key(c: Column | str) -> Column:
    """Name as a path-safe key: blanks and slashes become underscores."""
    return F.translate(_col(c), " /", "__")


def clamp(c: Column | str, low: float, high: float) -> Column:
    """Limit to [low, high]; NaN, the largest double, becomes ``high``, and so does NULL."""
    return F.greatest(F.lit(low), F.least(F.lit(high), _col(c)))


def within(y: Column | str, predicted: Column | str, tolerance: float) -> Column:
    """1 when the absolute error is inside the tolerance, bounds included, else 0."""
    return F.when(F.abs(_col(predicted) - _col(y)) <= F.lit(tolerance), 1).otherwise(0)


def is_blank(c: Column | str) -> Column:
    return F.coalesce(F.length(F.trim(_col(c))) == 0, F.lit(True))


def too_long(c: Column | str, limit: int = MAX_NAME_LENGTH) -> Column:
    return F.coalesce(F.length(F.trim(_col(c))) > limit, F.lit(False))


def bad_email(c: Column | str) -> Column:
    return ~F.coalesce(_col(c).rlike(EMAIL_PATTERN), F.lit(False))


def short_password(c: Column | str, minimum: int = MIN_PASSWORD_LENGTH) -> Column:
    return F.coalesce(F.length(_col(c)) < minimum, F.lit(True))


def first_reason(rules: Mapping[str, Column]) -> Column:
    """Name of the first rule that fires, NULL when none does."""
    return F.coalesce(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])


def collated(c: Column | str, collation: str | None = None) -> Column:
    """``c`` under a collation, e.g. ``UNICODE_CI_AI_RTRIM``; binary when none is named."""
    return F.collate(_col(c), collation) if collation else _col(c)


def display_view(
    df: DataFrame,
    date_col: str = "date",
    temperature_col: str = "temperature",
    humidity_col: str = "humidity",
    time_col: str = "extraction_time",
) -> DataFrame:
    """Add the report texts of a recipe line: date, °C, % and seconds."""
    return df.withColumns(
        {
            "date_text": F.date_format(date_col, "yyyy/M/d"),
            "temperature_text": F.concat(F.col(temperature_col).cast("string"), F.lit("°C")),
            "humidity_text": F.concat(F.col(humidity_col).cast("string"), F.lit("%")),
            "time_text": F.concat(F.col(time_col).cast("string"), F.lit("秒")),
        }
    )


def all_equal(pairs: Mapping[str, object]) -> Column:
    """Conjunction of column = value tests."""
    return reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in pairs.items()])
