"""R² and confidence expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from steepgrid.functions.columns import clamp

# Weights and limits of the composite confidence.
R2_WEIGHT = 0.4
STABILITY_WEIGHT = 0.3
SIZE_WEIGHT = 0.2
FOLD_STABILITY_WEIGHT = 0.1
FULL_SIZE = 50.0
LOWEST = 0.3
HIGHEST = 0.95
LOADED_MODEL_CONFIDENCE = 0.85
BATCH_CONFIDENCE = 0.8


def r2_from_sums(n: Column, sum_y: Column, sum_yy: Column, residual: Column) -> Column:
    """R² of one target from its sums.

    Fewer than two rows give NaN; a constant target gives 1 when every residual is zero, else 0.
    """
    spread = sum_yy - sum_y * sum_y / F.nullif(n, F.lit(0))
    flat = spread <= F.lit(1e-12) * F.greatest(sum_yy, F.lit(1e-300))
    return (
        F.when(n < 2, F.lit(float("nan")))
        .when(flat, F.when(residual <= F.lit(1e-12) * F.greatest(sum_yy, F.lit(1e-300)), 1.0).otherwise(0.0))
        .otherwise(F.lit(1.0) - residual / spread)
    )


def confidence(fold_mean: Column, fold_std: Column, train_r2: Column, spread: Column, n: Column) -> Column:
    """Composite confidence: fit, tree agreement, sample size and fold agreement, within [0.3, 0.95]."""
    fit = clamp((fold_mean + train_r2) / F.lit(2.0), 0.0, 1.0)
    agreement = clamp(F.lit(1.0) - spread / F.lit(2.0), 0.0, 1.0)
    size = F.least(F.lit(1.0), n / F.lit(FULL_SIZE))
    steadiness = clamp(F.lit(1.0) - fold_std, 0.0, 1.0)
    total = (
        fit * R2_WEIGHT
        + agreement * STABILITY_WEIGHT
        + size * SIZE_WEIGHT
        + steadiness * FOLD_STABILITY_WEIGHT
    )
    return clamp(total, LOWEST, HIGHEST)


def fallback_confidence(n: Column) -> Column:
    """Used when the metrics cannot be computed; no lower limit."""
    return F.least(F.lit(HIGHEST), F.lit(LOWEST) + (n - F.lit(10)) * F.lit(0.02))


def saved_confidence(n: Column) -> Column:
    """Confidence of a stored model from its sample count; constant when the count is unknown."""
    known = F.least(F.lit(HIGHEST), F.lit(0.7) + n / F.lit(100.0) * F.lit(0.2))
    return F.when(n.isNull(), F.lit(LOADED_MODEL_CONFIDENCE)).otherwise(known)
