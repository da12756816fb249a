"""Model training, confidence and hold-out evaluation for every bean at once.

A fold refit is just another model of the same fit: variant 0 sees all training rows and variant f those outside
fold f. So all fits of all beans are one chain of jobs that scans every row once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from steepgrid.functions.scores import confidence, fallback_confidence
from steepgrid.operators.features import MIN_TRAINING_ROWS, base_features, encode, feature_lists
from steepgrid.operators.forest import Forest, ForestSpec, fit_forest, predict
from steepgrid.operators.metrics import fold_stats, r2, tolerance_accuracy
from steepgrid.operators.ranks import number_rows
from steepgrid.operators.splits import assign_folds, fold_at
from steepgrid.schemas import TARGETS, TOLERANCES
from steepgrid.session import materialise

EXACT = ForestSpec(binning="exact")
WEATHER_ONLY = {"weather": "weather"}
WITH_ORIGIN = {"weather": "weather", "bean_origin": "origin"}


def train(
    brews: DataFrame,
    key: Sequence[str],
    group: str = "bean_name",
    categories: Mapping[str, str] = WEATHER_ONLY,
    targets: Sequence[str] = TARGETS,
    spec: ForestSpec = EXACT,
) -> tuple[Forest, DataFrame]:
    """(forests of all beans that pass the gate, their feature lists with sample counts).

    One pass finds the counts and lists of all beans; beans below the gate drop out of the list and
    with it out of the join that aligns the rows.
    """
    rows = base_features(brews)
    lists = materialise(gated_lists(rows, group, categories), "lists")
    encoded = encode(rows, lists, [group], categories).select(group, *key, *targets, "features", "ones")
    return fit_forest(materialise(encoded, "encoded"), [group], targets, key, spec, ones="ones"), lists


def gated_lists(rows: DataFrame, group: str, categories: Mapping[str, str]) -> DataFrame:
    """Feature lists of the beans with enough rows to train on."""
    return feature_lists(rows, [group], categories).where(F.col("sample_count") >= MIN_TRAINING_ROWS)


def confidence_parts(
    rows: DataFrame,
    group: str,
    key: Sequence[str],
    targets: Sequence[str],
    spec: ForestSpec,
    folds: int,
    tolerances: Mapping[str, float],
) -> DataFrame:
    """One row per bean with its accuracies and confidence.

    ``rows`` carries encoded features, targets, the fold of a training row, NULL for a test row, and group_size.
    """
    training = rows.where(F.col("fold").isNotNull())
    fitted = fit_forest(training, [group], targets, key, spec, folds=folds, fold="fold", ones="ones")
    # Test rows and the training R² use the full model; each row also meets the model that did not see its fold.
    roles = F.when(F.col("fold").isNull(), F.array(F.struct(F.lit(0).alias("variant"), F.lit("test").alias("role")))).otherwise(
        F.array(
            F.struct(F.lit(0).alias("variant"), F.lit("train").alias("role")),
            F.struct(F.col("fold").alias("variant"), F.lit("fold").alias("role")),
        )
    )
    asked = rows.withColumn("_role", F.explode(roles)).select("*", "_role.*").drop("_role")
    scored = materialise(
        predict(asked, fitted, [*key, "role", "fold", *targets], spread="spread_", ones="ones"), "scored"
    )
    pairs = {t: f"predicted_{t}" for t in targets}
    spread = sum((F.col(f"spread_{t}") for t in targets), F.lit(0.0)) / F.lit(float(len(targets)))

    fold_scores = r2(scored.where("role = 'fold'"), [group, "fold"], pairs)
    per_fold = fold_stats(fold_scores, [group])
    on_train = r2(scored.where("role = 'train'"), [group], pairs).select(
        group, F.col("n").alias("train_count"), F.col("r2").alias("train_r2")
    )
    agreement = scored.where("role = 'train'").groupBy(group).agg(F.avg(spread).alias("mean_std"))
    accuracy = tolerance_accuracy(scored.where("role = 'test'"), [group], pairs, tolerances)
    sizes = rows.groupBy(group).agg(
        F.count("*").alias("sample_count"), F.count(F.when(F.col("fold").isNull(), 1)).alias("test_count")
    )
    joined = (
        sizes.join(on_train, group, "left")
        .join(agreement, group, "left")
        .join(per_fold, group, "left")
        .join(accuracy, group, "left")
    )
    n = F.col("sample_count")
    measured = confidence(F.col("fold_mean"), F.col("fold_std"), F.col("train_r2"), F.col("mean_std"), n)
    return joined.withColumn(
        "confidence", F.when(F.col("train_count") >= 2, measured).otherwise(fallback_confidence(n))
    )


def evaluate(
    brews: DataFrame,
    key: Sequence[str],
    group: str = "bean_name",
    categories: Mapping[str, str] = WEATHER_ONLY,
    targets: Sequence[str] = TARGETS,
    tolerances: Mapping[str, float] = TOLERANCES,
    spec: ForestSpec = EXACT,
    frac: float = 0.1,
    seed: int = 42,
    folds: int = 3,
) -> DataFrame:
    """Evaluation report per bean: 9:1 split, fit on nine parts, accuracies on one, confidence.

    One numbering in digest order gives both the split and the folds of the training part.
    """
    based = base_features(brews)
    lists = materialise(feature_lists(based, [group], categories), "lists")
    encoded = encode(based, lists, [group], categories)
    text = F.concat(F.concat_ws("|", *[F.col(k).cast("string") for k in key]), F.lit(f":{seed}"))
    needed = encoded.select(group, *key, *targets, "features", "ones", F.md5(text).alias("_digest"))
    numbered = number_rows(needed, [group], ["_digest", *key], "_rn", "group_size")
    rows = materialise(with_folds(numbered, frac, folds).drop("_digest", "_rn"), "split")
    parts = confidence_parts(rows, group, key, targets, spec, folds, tolerances)
    counted = lists.select(group, F.size("feature_names").alias("feature_count"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return parts.join(counted, group).select(
        group,
        "sample_count",
        F.col("test_count").alias("eval_sample_count"),
        "confidence",
        "feature_count",
        F.struct(
            F.struct(*[F.lit(tolerances[t]).alias(t) for t in targets]).alias("tolerance"),
            F.struct(*[zero(f"acc_{t}").alias(t) for t in targets]).alias("per_target"),
            zero("acc_overall").alias("overall"),
        ).alias("tolerance_accuracy"),
    )


def with_folds(numbered: DataFrame, frac: float, folds: int) -> DataFrame:
    """Fold of every row behind the ceil(frac * n) test rows, NULL for the test rows."""
    tests = F.ceil(F.lit(frac) * F.col("group_size"))
    place = F.col("_rn") - tests - 1
    return numbered.withColumn("fold", F.when(place >= 0, fold_at(place, F.col("group_size") - tests, folds)))


def trained_confidence(
    brews: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    group: str = "bean_name",
    categories: Mapping[str, str] = WEATHER_ONLY,
    targets: Sequence[str] = TARGETS,
    spec: ForestSpec = EXACT,
    folds: int = 3,
) -> DataFrame:
    """Confidence of freshly trained models: all rows train, folds follow the stored order."""
    based = base_features(brews)
    lists = materialise(gated_lists(based, group, categories), "lists")
    encoded = encode(based, lists, [group], categories).select(
        group, *dict.fromkeys([*key, *order, *targets]), "features", "ones"
    )
    rows = materialise(
        assign_folds(encoded, [group], order, folds).withColumn("group_size", F.lit(0)), "folds"
    )
    parts = confidence_parts(rows, group, key, targets, spec, folds, dict.fromkeys(targets, 0.0))
    return parts.select(group, "sample_count", "confidence")
