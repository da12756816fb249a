"""Stored models: node tables, one registry row per bean, and scoring of requests against them."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from steepgrid.functions.columns import default_days, fill_weather, parse_day, date_parts, safe_key
from steepgrid.functions.scores import BATCH_CONFIDENCE, LOADED_MODEL_CONFIDENCE, saved_confidence
from steepgrid.operators.changes import upsert
from steepgrid.operators.features import encode
from steepgrid.operators.forest import Forest, predict
from steepgrid.schemas import BASE_FEATURES, TARGETS
from steepgrid.sources.tables import latest_version, read_latest, read_version, write_version

MODEL_TYPE = "multi-output random forest"
REGISTRY, ROOTS, SPLITS = "registry", "roots", "splits"
MODEL_VERSION = "model_version"  # the folder that holds a bean's trees


def registry_rows(
    lists: DataFrame,
    bean: str,
    as_of: str,
    targets: Sequence[str] = TARGETS,
    categories: Sequence[str] = ("weather",),
    numerical: Sequence[str] = BASE_FEATURES,
    data_source: str = "recipe",
) -> DataFrame:
    """One registry row per bean from its feature list and sample count."""
    return lists.select(
        F.col(bean).alias("bean_name"),
        safe_key(bean).alias("model_key"),
        "feature_names",
        F.array(*[F.lit(t) for t in targets]).alias("target_names"),
        F.array(*[F.lit(c) for c in categories]).alias("categorical_columns"),
        F.array(*[F.lit(c) for c in numerical]).alias("numerical_columns"),
        F.lit(data_source).alias("data_source"),
        F.lit(as_of).alias("last_updated"),
        F.col("sample_count").cast("bigint").alias("sample_count"),
        F.lit(None).cast("string").alias("model_version"),
    )


def register_model(spark: SparkSession, base: str, rows: DataFrame, after: int | None = None) -> int:
    """Insert or replace the beans' registry rows as a new version of the registry.

    ``after`` is the registry version that the caller has read; if another one was committed since, this one fails.
    """
    path = f"{base}/{REGISTRY}"
    known = latest_version(spark, path) or 0 if after is None else after
    merged = upsert(read_version(spark, path, known), rows, "bean_name") if known else rows
    return write_version(merged, path, known)


def save_model(spark: SparkSession, base: str, forest: Forest, registry: DataFrame) -> int:
    """Store the forests of all beans in ``registry`` and register them, all at once for readers.

    Trees go to a folder of their own, which nobody reads until a registry row names it: the registry's commit is the
    only moment at which readers change. Beans that are not in ``registry`` keep the folders they have, so
    nothing is copied. Of two writers that started from the same registry, the later commit fails.
    """
    bean = forest.group[0]
    after = latest_version(spark, f"{base}/{REGISTRY}") or 0
    version = f"v-{uuid.uuid4().hex}"
    for name, rows in ((ROOTS, forest.roots), (SPLITS, forest.splits())):
        # files stay sorted by bean for pruned reads
        kept = rows.withColumnRenamed(bean, "bean_name").repartitionByRange("bean_name", "tree")
        kept.sortWithinPartitions("bean_name").write.parquet(f"{base}/{name}/{MODEL_VERSION}={version}")
    return register_model(spark, base, registry.withColumn(MODEL_VERSION, F.lit(version)), after)


def load_registry(spark: SparkSession, base: str) -> DataFrame:
    return read_latest(spark, f"{base}/{REGISTRY}")


def load_model(
    spark: SparkSession,
    base: str,
    beans: Sequence[str] | None = None,
    targets: Sequence[str] = TARGETS,
    registry: DataFrame | None = None,
) -> Forest:
    """Stored forests of the named beans, or of all, as one state of the registry names them.

    Pass the ``registry`` that goes with the forests where both are needed.
    """
    rows = load_registry(spark, base) if registry is None else registry
    named = rows.select("bean_name", MODEL_VERSION)
    if beans is not None:
        named = named.where(F.col("bean_name").isin(list(beans)))
    versions = [r[MODEL_VERSION] for r in named.select(MODEL_VERSION).distinct().collect()]  # at most one per save

    def stored(name: str) -> DataFrame:
        path = f"{base}/{name}"
        folders = [f"{path}/{MODEL_VERSION}={v}" for v in versions if v is not None]
        if not folders:
            raise FileNotFoundError(f"no stored model of these beans under {base}")
        found = spark.read.option("basePath", path).parquet(*folders)
        return found.join(named, ["bean_name", MODEL_VERSION], "left_semi").drop(MODEL_VERSION)

    return Forest(["bean_name"], list(targets), stored(ROOTS), stored(SPLITS))


def request_features(requests: DataFrame) -> DataFrame:
    """Requests with date parts and the defaults for measurements they leave out."""
    dated = requests.withColumn("_date", parse_day("date", "yyyy-MM-dd"))
    filled = fill_weather(date_parts(dated, "_date")).drop("_date")
    return filled.withColumn("days_passed", default_days("days_passed"))


def _score(
    requests: DataFrame,
    forest: Forest,
    registry: DataFrame,
    key: str,
    categories: Mapping[str, str],
    confidence: Column,
) -> DataFrame:
    """Every request with its prediction; a bean without a model gets status no_model and NULLs."""
    encoded = encode(request_features(requests), registry, ["bean_name"], categories)
    predictions = predict(encoded, forest, [key], prefix="", ones="ones").drop("bean_name")
    known = registry.select("bean_name", "sample_count", F.lit("ok").alias("_status"))
    joined = requests.join(known, "bean_name", "left").join(predictions, key, "left")
    return joined.withColumn("status", F.coalesce("_status", F.lit("no_model"))).withColumn(
        "confidence", F.when(F.col("status") == "ok", confidence)
    ).drop("_status", "sample_count")


def score_saved(
    requests: DataFrame, forest: Forest, registry: DataFrame, key: str = "request_id"
) -> DataFrame:
    """Stored models, weather features; confidence from the sample count."""
    return _score(requests, forest, registry, key, {"weather": "weather"}, saved_confidence(F.col("sample_count")))


def score_registry(
    requests: DataFrame, forest: Forest, registry: DataFrame, key: str = "request_id"
) -> DataFrame:
    """Stored models, weather and origin features; constant confidence."""
    return _score(
        requests, forest, registry, key,
        {"weather": "weather", "bean_origin": "origin"}, F.lit(LOADED_MODEL_CONFIDENCE),
    )


def score_batch(
    requests: DataFrame, forest: Forest, registry: DataFrame, key: str = "request_id"
) -> DataFrame:
    """Many requests of many beans at once, inputs echoed; constant confidence."""
    return _score(
        requests, forest, registry, key,
        {"weather": "weather", "bean_origin": "origin"}, F.lit(BATCH_CONFIDENCE),
    )


def model_info(registry: DataFrame) -> DataFrame:
    """Features, targets, type, source and column kinds per model."""
    return registry.select(
        "bean_name",
        F.size("feature_names").alias("feature_count"),
        "feature_names",
        "target_names",
        "categorical_columns",
        "numerical_columns",
        "data_source",
        F.lit(MODEL_TYPE).alias("model_type"),
        "sample_count",
        "last_updated",
    )


def model_status(registry: DataFrame) -> DataFrame:
    """Number of stored models and the mode: dynamic without any, else mixed."""
    return registry.agg(F.count("*").alias("model_count")).withColumn(
        "mode", F.when(F.col("model_count") == 0, "dynamic").otherwise("mixed")
    )
