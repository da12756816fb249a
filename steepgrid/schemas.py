"""Fixed schemas of the brew tables."""

from pyspark.sql import types as T

USERS = T.StructType(
    [
        T.StructField("id", T.IntegerType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("email", T.StringType(), False),
        T.StructField("role", T.StringType(), False),
    ]
)

BEANS = T.StructType(
    [
        T.StructField("id", T.IntegerType(), False),
        T.StructField("user_id", T.IntegerType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("from_location", T.StringType(), False),
    ]
)

RECIPE = T.StructType(
    [
        T.StructField("id", T.IntegerType(), False),
        T.StructField("bean_id", T.IntegerType(), False),
        T.StructField("date", T.DateType(), False),
        T.StructField("weather", T.StringType(), False),
        T.StructField("temperature", T.FloatType(), True),
        T.StructField("humidity", T.IntegerType(), True),
        T.StructField("gram", T.FloatType(), False),
        T.StructField("mesh", T.FloatType(), False),
        T.StructField("extraction_time", T.FloatType(), False),
        T.StructField("days_passed", T.FloatType(), True),
    ]
)

MONTHLY_LOG = T.StructType(
    [
        T.StructField("Day", T.StringType(), True),
        T.StructField("Weather", T.StringType(), True),
        T.StructField("days_passed", T.DoubleType(), True),
        T.StructField("mesh", T.DoubleType(), True),
        T.StructField("gram", T.DoubleType(), True),
        T.StructField("extraction_time", T.LongType(), True),
    ]
)

DAILY_WEATHER = T.StructType(
    [
        T.StructField("date", T.DateType(), True),
        T.StructField("temperature", T.DoubleType(), True),
        T.StructField("humidity", T.DoubleType(), True),
    ]
)

OBSERVATION = T.StructType(
    [
        T.StructField(
            "main",
            T.StructType(
                [
                    T.StructField("temp", T.DoubleType(), True),
                    T.StructField("humidity", T.DoubleType(), True),
                    T.StructField("pressure", T.DoubleType(), True),
                ]
            ),
            True,
        ),
        T.StructField(
            "weather",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("main", T.StringType(), True),
                        T.StructField("description", T.StringType(), True),
                    ]
                )
            ),
            True,
        ),
    ]
)

REQUEST = T.StructType(
    [
        T.StructField("request_id", T.LongType(), False),
        T.StructField("bean_name", T.StringType(), False),
        T.StructField("bean_origin", T.StringType(), True),
        T.StructField("date", T.StringType(), False),
        T.StructField("weather", T.StringType(), False),
        T.StructField("temperature", T.DoubleType(), True),
        T.StructField("humidity", T.DoubleType(), True),
        T.StructField("days_passed", T.DoubleType(), True),
    ]
)

# Column order of a merged brew row before the weather columns are added.
CANONICAL = [
    "date", "year", "month", "day", "day_of_week", "weather", "days_passed",
    "mesh", "gram", "extraction_time", "bean_name", "user_name",
]

# Columns an insert fills; the id comes from the table.
INSERT_COLUMNS = [
    "bean_id", "date", "weather", "temperature", "humidity",
    "gram", "mesh", "extraction_time", "days_passed",
]

# Key, targets, tolerances and numeric features of the models.
IDEMPOTENCE_KEY = ["bean_id", "date", "extraction_time"]

TARGETS = ["mesh", "gram", "extraction_time"]

TOLERANCES = {"mesh": 0.1, "gram": 0.3, "extraction_time": 5.0}

BASE_FEATURES = ["temperature", "humidity", "year", "month", "day", "day_of_week", "days_passed"]
