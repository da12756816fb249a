"""Generated starter rows for an empty store; the date they count back from is a parameter."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from steepgrid.schemas import BEANS, RECIPE, USERS


@dataclass(frozen=True)
class Series:
    """Arithmetic of one bean's generated recipes: start + (i mod cycle) * step for each measure."""

    bean_id: int
    day_offset: int
    temperature: tuple[float, int, float]
    humidity: tuple[int, int, int]
    mesh: tuple[float, int, float]
    gram: tuple[float, int, float]
    extraction_time: tuple[float, int, float]
    days_passed: tuple[float, int, float]


# Fixed values: (start, cycle, step) of the two generated series.
SERIES = (
    Series(2, 20, (16.0, 14, 1.0), (45, 35, 1), (16.5, 4, 0.5), (2.1, 5, 0.1), (26.0, 9, 1.0), (12.0, 8, 1.0)),
    Series(3, 40, (17.0, 13, 1.0), (48, 32, 1), (17.5, 3, 0.5), (2.2, 4, 0.1), (27.0, 8, 1.0), (15.0, 5, 1.0)),
)

SERIES_LENGTH = 20

# The users (name, e-mail, role), numbered from 1.
STARTER_USERS = (
    ("コーヒー愛好家", "coffee.lover@example.com", "ROLE_USER"),
    ("エスプレッソ職人", "espresso.pro@example.com", "ROLE_USER"),
    ("ホームロースター", "home.roaster@example.com", "ROLE_ADMIN"),
)

# The beans (owner, name, origin), numbered from 1.
STARTER_BEANS = (
    (1, "エチオピア イルガチェフェ", "エチオピア"),
    (1, "グアテマラ アンティグア", "グアテマラ"),
    (2, "ブラジル サントス", "ブラジル"),
    (2, "コロンビア スプレモ", "コロンビア"),
    (2, "ケニア AA", "ケニア"),
    (3, "インドネシア マンデリン", "インドネシア"),
    (3, "パナマ ゲイシャ", "パナマ"),
    (3, "タンザニア キリマンジャロ", "タンザニア"),
)

# The single recipes (bean, days ago, weather, temperature, humidity, mesh, gram, extraction time, days passed).
STARTER_RECIPES = (
    (4, 1, "晴れ", 24.0, 58, 18.2, 2.4, 29.5, 15.0),
    (4, 6, "雨", 19.0, 85, 19.3, 2.8, 36.0, 12.0),
    (5, 2, "曇り", 21.5, 70, 18.8, 2.6, 33.0, 18.0),
    (6, 7, "雨", 18.0, 88, 19.5, 2.9, 38.0, 10.0),
    (6, 8, "曇り", 20.5, 72, 18.7, 2.5, 32.5, 16.0),
    (7, 1, "晴れ", 26.0, 52, 17.8, 2.1, 27.0, 14.0),
    (8, 3, "雪", 2.0, 40, 19.0, 2.6, 34.0, 20.0),
)


def starter_tables(spark: SparkSession, as_of: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(users, beans, recipes) of a new store: the generated series, then the single recipes, counting back from ``as_of``."""
    users = spark.createDataFrame([(i, *user) for i, user in enumerate(STARTER_USERS, 1)], USERS)
    beans = spark.createDataFrame([(i, *bean) for i, bean in enumerate(STARTER_BEANS, 1)], BEANS)
    single = spark.createDataFrame(
        [(i, *row) for i, row in enumerate(STARTER_RECIPES, SERIES_LENGTH * len(SERIES) + 1)],
        "id int, bean_id int, ago int, weather string, temperature float, humidity int, mesh float, gram float, "
        "extraction_time float, days_passed float",
    ).withColumn("date", F.date_sub(F.to_date(F.lit(as_of)), F.col("ago")))
    columns = [F.col(f.name).cast(f.dataType) for f in RECIPE]
    recipes = single.select(*columns)
    for k, rule in enumerate(SERIES):
        # a series counts back a day a row, so a row's number is its distance from the series' first day
        first = F.date_sub(F.to_date(F.lit(as_of)), F.lit(rule.day_offset))
        rows = seed_recipes(spark, SERIES_LENGTH, as_of, rule)
        rows = rows.withColumn("id", F.datediff(first, "date") + F.lit(k * SERIES_LENGTH))
        recipes = recipes.unionByName(rows.select(*columns))
    return users, beans, recipes


def seed_recipes(spark: SparkSession, n: int, as_of: str, series: Series) -> DataFrame:
    """``n`` recipes, one per day, counting back from ``as_of``."""
    i = F.col("i")

    def ramp(rule: tuple[float, int, float], kind: str):
        start, cycle, step = rule
        return (F.lit(start) + F.pmod(i, F.lit(cycle)) * F.lit(step)).cast(kind)

    weather = (
        F.when(F.pmod(i, F.lit(4)) == 0, "晴れ")
        .when(F.pmod(i, F.lit(4)) == 1, "曇り")
        .when(F.pmod(i, F.lit(4)) == 2, "雨")
        .otherwise("雪")
    )
    return spark.range(1, n + 1).select(F.col("id").cast("int").alias("i")).select(
        F.lit(series.bean_id).alias("bean_id"),
        F.date_sub(F.to_date(F.lit(as_of)), i + F.lit(series.day_offset)).alias("date"),
        weather.alias("weather"),
        ramp(series.temperature, "float").alias("temperature"),
        ramp(series.humidity, "int").alias("humidity"),
        ramp(series.gram, "float").alias("gram"),
        ramp(series.mesh, "float").alias("mesh"),
        ramp(series.extraction_time, "float").alias("extraction_time"),
        ramp(series.days_passed, "float").alias("days_passed"),
    )


def seed_if_empty(tables: list[DataFrame], seed: DataFrame) -> DataFrame:
    """The seed rows when every table is empty, otherwise none; decided inside the plan."""
    probe = tables[0].select(F.lit(1).alias("one")).limit(1)
    for table in tables[1:]:
        probe = probe.unionAll(table.select(F.lit(1).alias("one")).limit(1))
    filled = probe.agg(F.count("*").alias("n"))
    return seed.where(filled.scalar() == 0)
