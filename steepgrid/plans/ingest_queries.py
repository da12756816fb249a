"""Parsing, normalising, weather joins and observations on the star-schema tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from steepgrid.functions import columns
from steepgrid.operators.reads import join_weather
from steepgrid.plans.catalog import query, table
from steepgrid.session import materialise, scratch_dir
from steepgrid.sources.logs import (
    NoReadableLog,
    canonical,
    concat_frames,
    read_monthly,
    read_weather,
    require_rows,
    split_quarantine,
    with_file_tags,
    write_merged,
)
from steepgrid.sources.observations import observation_defaults, parse_observations
from steepgrid.sources.seed import SERIES, seed_if_empty, seed_recipes

# Days between the first order date and the first event date; both sides of the weather join use it.
DAY_SHIFT = 9496


@query(
    """
    SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, CAST(year(o_orderdate) AS INT) AS year,
           CAST(month(o_orderdate) AS INT) AS month, CAST(day(o_orderdate) AS INT) AS day,
           CAST(isodow(o_orderdate) - 1 AS INT) AS day_of_week
    FROM orders
    """
)
def date_features(spark, sf):
    texts = table(spark, sf, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", columns.DAY_FORMAT).alias("day_text")
    )
    return columns.date_parts(texts.withColumn("date", columns.parse_day("day_text"))).drop("day_text")


WORDS_SQL = """CASE event_type WHEN 'view' THEN '晴' WHEN 'signup' THEN 'くもり' WHEN 'error' THEN 'くもり/雨'
    WHEN 'click' THEN 'くもり/晴' END"""


def _words():
    kind = F.col("event_type")
    return (
        F.when(kind == "view", "晴").when(kind == "signup", "くもり").when(kind == "error", "くもり/雨").when(kind == "click", "くもり/晴")
    )


@query(
    f"""
    SELECT event_id, CASE {WORDS_SQL} WHEN '晴' THEN '晴れ' WHEN 'くもり' THEN '曇り' WHEN '雨' THEN '雨'
        WHEN 'くもり/雨' THEN '雨' WHEN '雪' THEN '雪' ELSE '晴れ' END AS weather
    FROM events
    """
)
def normalise_weather(spark, sf):
    words = table(spark, sf, "events").withColumn("word", _words())
    return words.select("event_id", columns.normalise_weather("word").alias("weather"))


API_SQL = """CASE event_type WHEN 'view' THEN 'Clear' WHEN 'signup' THEN 'Clouds' WHEN 'error' THEN 'Thunderstorm'
    WHEN 'click' THEN 'Sand' END"""


def _api_words():
    kind = F.col("event_type")
    return (
        F.when(kind == "view", "Clear").when(kind == "signup", "Clouds").when(kind == "error", "Thunderstorm").when(kind == "click", "Sand")
    )


@query(
    f"""
    SELECT event_id, CASE {API_SQL} WHEN 'Clear' THEN '晴れ' WHEN 'Clouds' THEN '曇り' WHEN 'Rain' THEN '雨'
        WHEN 'Snow' THEN '雪' WHEN 'Thunderstorm' THEN '雨' WHEN 'Drizzle' THEN '雨' WHEN 'Mist' THEN '曇り'
        WHEN 'Fog' THEN '曇り' ELSE '晴れ' END AS weather
    FROM events
    """
)
def map_api_weather(spark, sf):
    words = table(spark, sf, "events").withColumn("word", _api_words())
    return words.select("event_id", columns.map_api_weather("word").alias("weather"))


@query(
    """
    SELECT event_id, floor((value - 50.0::DOUBLE) * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS temperature,
           floor(value + 0.5::DOUBLE) AS humidity, CAST(round(value) AS INT) AS stored_humidity,
           TRY_CAST(trim(regexp_extract(props, ':(.*)}', 1)) AS DOUBLE) AS number,
           TRY_CAST(event_type AS INT) AS not_a_number
    FROM events
    """
)
def measurement_rounding(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        columns.round_half_up(F.col("value") - 50.0, 1).alias("temperature"),
        columns.round_half_up("value").alias("humidity"),
        columns.round_int("value").alias("stored_humidity"),
        columns.to_number(F.regexp_extract("props", ":(.*)}", 1)).alias("number"),
        columns.to_number("event_type", "int").alias("not_a_number"),
    )


@query("SELECT p_partkey, translate(p_name || '/' || p_brand, ' /', '__') AS model_key FROM part")
def safe_keys(spark, sf):
    name = F.concat_ws("/", "p_name", "p_brand")
    return table(spark, sf, "part").select("p_partkey", columns.safe_key(name).alias("model_key"))


@query(
    f"""
    WITH daily AS (
        SELECT CAST(ts AS DATE) - {DAY_SHIFT} AS date, ROUND(AVG(value), 4) AS temperature,
               ROUND(AVG(CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE)), 4) AS humidity
        FROM events GROUP BY 1)
    SELECT o_orderkey, date, COALESCE(temperature, 20.0) AS temperature,
           CAST(ROUND(COALESCE(humidity, 60.0)) AS INT) AS humidity
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders) LEFT JOIN daily USING (date)
    """
)
def daily_weather_join(spark, sf):
    daily = (
        table(spark, sf, "events")
        .groupBy(F.date_sub(F.to_date("ts"), DAY_SHIFT).alias("date"))
        .agg(
            F.round(F.avg("value"), 4).alias("temperature"),
            F.round(F.avg(F.regexp_extract("props", "([0-9]+)", 1).cast("double")), 4).alias("humidity"),
        )
    )
    brews = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    merged = columns.fill_weather(join_weather(brews, materialise(daily, "daily")))
    return merged.select("o_orderkey", "date", "temperature", columns.round_int("humidity").alias("humidity"))


@query(
    f"""
    WITH payload AS (SELECT event_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k,
                            {API_SQL} AS word FROM events)
    SELECT event_id,
           CASE WHEN event_type IN ('view', 'error') THEN value ELSE 20.0 END AS temperature,
           CASE WHEN event_type IN ('view', 'error', 'signup') THEN k ELSE 60.0 END AS humidity,
           CAST(1013.25 AS DOUBLE) AS pressure,
           CASE WHEN event_type = 'purchase' THEN 'Clear' ELSE word END AS category,
           CASE WHEN event_type = 'view' THEN 'fine' ELSE '' END AS description
    FROM payload
    """
)
def parse_weather_observations(spark, sf):
    kind = F.col("event_type")
    number = F.regexp_extract("props", "([0-9]+)", 1).cast("double")
    payloads = table(spark, sf, "events").select(
        "event_id",
        F.when(kind == "purchase", F.lit("{}"))
        .otherwise(
            F.to_json(
                F.struct(
                    F.struct(
                        F.when(kind.isin("view", "error"), F.col("value")).alias("temp"),
                        F.when(kind.isin("view", "error", "signup"), number).alias("humidity"),
                    ).alias("main"),
                    F.array(
                        F.struct(_api_words().alias("main"), F.when(kind == "view", "fine").alias("description"))
                    ).alias("weather"),
                )
            )
        )
        .alias("payload"),
    )
    return observation_defaults(parse_observations(payloads, "payload")).drop("payload")


@query(
    """
    SELECT event_id, event_type FROM events WHERE value < 50
    UNION ALL SELECT event_id, event_type FROM events WHERE value >= 20
    """
)
def concat_event_frames(spark, sf):
    events = table(spark, sf, "events")
    low = events.where(F.col("value") < 50).select("event_id", "event_type")
    high = events.where(F.col("value") >= 20).select("event_type", "event_id")
    return concat_frames(low, high)


# --- CSV: the given tables written as logs, read back by the operators ------------------------------------

LOG_TAGS = {"1995_03": ("Sidamo", "Aki"), "1996_11": ("Kona", "Bo")}
LOG_DEFAULT = ("Huila", "Cy")

# Every order is a brew of its month's log. A month with an order whose key is divisible by 1499 holds a day that
# cannot be read, one with a key divisible by 1511 a number that is none, one with 1523 a row without its last field.
LOGS_SQL = f"""
    logs AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, strftime(o_orderdate, '%Y_%m') AS month,
               CASE o_orderstatus WHEN 'F' THEN '晴れ' WHEN 'O' THEN '雨' ELSE '晴れ' END AS weather,
               CASE WHEN o_orderpriority <> '5-LOW' THEN CAST(o_custkey % 30 AS DOUBLE) END AS days_passed,
               o_totalprice AS mesh, CAST(o_custkey AS DOUBLE) / 8 AS gram
             FROM orders),
    bad AS (SELECT month, COUNT(*) AS bad_rows, bool_or(broken) AS row, bool_or(NOT broken) AS day
            FROM (SELECT *, o_orderkey % 1511 = 0 OR o_orderkey % 1523 = 0 AS broken FROM logs) WHERE o_orderkey % 1499 = 0 OR o_orderkey % 1511 = 0 OR o_orderkey % 1523 = 0 GROUP BY month)
"""


def _written_logs(spark, sf) -> str:
    """The orders as CSV logs, a folder a month; returns the glob of the files."""
    key = F.col("o_orderkey")
    day = F.when(key % 1499 == 0, "no day").otherwise(F.date_format("o_orderdate", columns.DAY_FORMAT))
    gram = F.when(key % 1511 == 0, "some").otherwise((F.col("o_custkey") / 8).cast("string"))
    word = F.when(F.col("o_orderstatus") == "F", "晴").when(F.col("o_orderstatus") == "O", "くもり/雨").otherwise("晴/雪")
    days = F.when(F.col("o_orderpriority") != "5-LOW", (F.col("o_custkey") % 30).cast("string")).otherwise("")
    fields = F.concat_ws(",", day, word, days, F.col("o_totalprice").cast("string"), gram)
    line = F.when(key % 1523 == 0, fields).otherwise(F.concat_ws(",", fields, key.cast("string")))
    path = f"{scratch_dir(spark)}/logs-{uuid.uuid4().hex}"
    lines = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy_MM").alias("month"), line.alias("value"))
    header = "Day,Weather,days_passed,mesh,gram,extraction_time"
    heads = lines.select("month").distinct().withColumn("value", F.lit(header))
    # the header is the first line of every file, so a month is one file here
    ordered = heads.withColumn("at", F.lit(0)).unionByName(lines.withColumn("at", F.lit(1)))
    ordered.repartition("month").sortWithinPartitions("month", "at").drop("at").write.partitionBy("month").text(path)
    return f"{path}/month=*/*.txt"


def _sound_logs(spark, sf):
    return split_quarantine(read_monthly(spark, _written_logs(spark, sf)))


@query(
    f"""
    WITH {LOGS_SQL}
    SELECT date, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, CAST(day(date) AS INT) AS day,
           CAST(isodow(date) - 1 AS INT) AS day_of_week, weather, days_passed, mesh, gram, o_orderkey AS extraction_time,
           CASE month WHEN '1995_03' THEN 'Sidamo' WHEN '1996_11' THEN 'Kona' ELSE 'Huila' END AS bean_name,
           CASE month WHEN '1995_03' THEN 'Aki' WHEN '1996_11' THEN 'Bo' ELSE 'Cy' END AS user_name
    FROM logs WHERE month NOT IN (SELECT month FROM bad)
    """
)
def csv_logs(spark, sf):
    sound, _ = _sound_logs(spark, sf)
    try:
        sound = require_rows(sound)
    except NoReadableLog:
        pass  # large tables put a bad row into every month; the answer is then no rows
    return canonical(with_file_tags(sound, LOG_TAGS, LOG_DEFAULT))


@query(
    f"""
    WITH {LOGS_SQL}
    SELECT month, bad_rows, concat_ws(',', CASE WHEN day THEN 'day' END, CASE WHEN row THEN 'row' END) AS reasons FROM bad
    """
)
def csv_quarantine(spark, sf):
    _, bad = _sound_logs(spark, sf)
    month = F.regexp_extract("file_path", "month=([0-9_]+)", 1)
    return bad.select(month.alias("month"), "bad_rows", F.array_join("reasons", ",").alias("reasons"))


@query(
    f"""
    WITH daily AS (SELECT CAST(ts AS DATE) - {DAY_SHIFT} AS date, ROUND(AVG(value), 4) AS temperature,
                          CAST(COUNT(*) AS DOUBLE) AS humidity FROM events GROUP BY 1)
    SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, temperature, humidity
    FROM orders LEFT JOIN daily ON CAST(o_orderdate AS DATE) = daily.date
    """
)
def csv_weather(spark, sf):
    """Daily weather written as CSV and read back, joined, and the merged rows written and read once more."""
    path = f"{scratch_dir(spark)}/weather-{uuid.uuid4().hex}"
    daily = table(spark, sf, "events").groupBy(F.date_sub(F.to_date("ts"), DAY_SHIFT).alias("date")).agg(
        F.round(F.avg("value"), 4).alias("temperature"), F.count("*").cast("double").alias("humidity")
    )
    write_merged(daily, f"{path}/daily")
    brews = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    write_merged(join_weather(brews, read_weather(spark, f"{path}/daily")), f"{path}/merged")
    schema = "date date, o_orderkey long, temperature double, humidity double"
    return spark.read.schema(schema).option("header", True).csv(f"{path}/merged")


@query(
    """
    SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, CAST(NULL AS DOUBLE) AS temperature, CAST(NULL AS DOUBLE) AS humidity
    FROM orders
    """
)
def csv_weather_missing(spark, sf):
    absent = read_weather(spark, f"{scratch_dir(spark)}/no-weather-{uuid.uuid4().hex}", missing="empty")
    return join_weather(table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date")), absent)


SEED_AS_OF = "1999-06-30"


@query(
    f"""
    SELECT 2 AS bean_id, CAST(DATE '{SEED_AS_OF}' - CAST(i + 20 AS INTEGER) AS DATE) AS date,
           CASE i % 4 WHEN 0 THEN '晴れ' WHEN 1 THEN '曇り' WHEN 2 THEN '雨' ELSE '雪' END AS weather,
           CAST(45 + i % 35 AS INTEGER) AS humidity, CAST(ROUND((2.1 + (i % 5) * 0.1) * 10) AS INTEGER) AS decigram,
           CAST(ROUND((16.5 + (i % 4) * 0.5) * 10) AS INTEGER) AS decimesh
    FROM range(1, (SELECT COUNT(*) FROM orders) + 1) r(i)
    """
)
def seed_into_empty_tables(spark, sf):
    """As many generated recipes as there are orders, as the store holds no order of the year 2020."""
    orders = table(spark, sf, "orders")
    stored = orders.where(F.year("o_orderdate") == 2020)
    rows = seed_if_empty([stored, stored], seed_recipes(spark, orders.count(), SEED_AS_OF, SERIES[0]))
    tenths = lambda c: F.round(F.col(c).cast("double") * 10).cast("int")
    return rows.select("bean_id", "date", "weather", "humidity", tenths("gram").alias("decigram"), tenths("mesh").alias("decimesh"))


@query("SELECT 0 AS bean_id WHERE (SELECT COUNT(*) FROM orders) = 0")
def seed_into_filled_tables(spark, sf):
    orders = table(spark, sf, "orders")
    empty = orders.where(F.year("o_orderdate") == 2020)
    return seed_if_empty([empty, orders], seed_recipes(spark, orders.count(), SEED_AS_OF, SERIES[0])).select("bean_id")
