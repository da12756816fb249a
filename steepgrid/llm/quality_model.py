"""Quality scores: random Fourier features of text statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from steepgrid.llm.text_stats import base_counts
from steepgrid.llm.words import batched, forget_words, rows_of, split_words, unused
from steepgrid.session import materialise

FEATURES = 256
RIDGE = 1e-3  # per labelled row
THRESHOLD = 0.7
SEED = 11
BINS = 2000  # steps of a raw score between -0.5 and 1.5 in which calibration counts labels
HELD_OUT = 2  # remainder of the id's CRC-32 by four
FOLDS = 4

_ROWS = pa.schema([("id", pa.int64()), ("stats", pa.list_(pa.float32()))])


def statistics(text: str, words: list[bytes]) -> list[float]:
    """Numbers that describe a whole text, whatever its language."""
    n, chars, symbols, lines, repeated, repeats = base_counts(text, words)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    of = np.bincount(raw, minlength=256)
    size, per_word = max(1, len(raw)), max(1, n)
    share = of[of > 0] / size
    lengths = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1)
    letters_low, letters_up = of[97:123].sum(), of[65:91].sum()
    single = {bytes([b]): int(of[b]) for b in b"#*$%&|<>!?.,@/:-_"}
    return [
        np.log1p(n),
        np.log1p(lines),
        chars / per_word,
        float(lengths.std()),
        np.log1p(float(lengths.max())),
        n / max(1, lines),
        letters_up / max(1, letters_up + letters_low),
        letters_low / size,
        of[48:58].sum() / size,
        of[128:].sum() / size,
        symbols / per_word,
        repeated / max(1, lines),
        repeats / per_word,
        len(set(words)) / per_word,
        float(-(share * np.log2(share)).sum()) if len(raw) else 0.0,
        *(count / per_word for count in single.values()),
    ]


N_STATS = 15 + 17


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:

    def rows():
        for key, text in rows_of(batches, "id", "text"):
            text = text or ""
            yield key, statistics(text, split_words(text))

    yield from batched(rows(), _ROWS)
    forget_words()


class Features:
    """Random Fourier features of standardised statistics: inner products approximate a Gaussian kernel."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, count: int, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.directions = rng.standard_normal((len(mean), count)) / np.sqrt(len(mean))
        self.phases = rng.uniform(0, 2 * np.pi, count)

    def of(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.sqrt(2 / len(self.phases)) * np.cos(x @ self.directions + self.phases)
        return np.hstack([z, np.ones((len(z), 1))])


def _stack(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS).astype(float)


def _normal_equations(features: Features):
    """Per partition and fold, the rows of [Z'Z, Z'y]: partial sums of a fixed size."""
    width = len(features.phases) + 1
    schema = pa.schema([("fold", pa.int32()), ("row", pa.int32()), ("sums", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            z = features.of(_stack(batch))
            y = batch.column("quality").to_numpy(zero_copy_only=False).astype(float)
            folds = batch.column("fold").to_numpy(zero_copy_only=False)
            for fold in np.unique(folds):
                own = folds == fold
                both = np.hstack([z[own], y[own, None]])
                sums[fold] = sums.get(fold, 0) + z[own].T @ both
        for fold, total in sums.items():
            yield pa.record_batch(
                [
                    pa.array([int(fold)] * width, pa.int32()),
                    pa.array(range(width), pa.int32()),
                    pa.array(list(total), pa.list_(pa.float64())),
                ],
                schema=schema,
            )

    return run


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.sum(np.stack(pdf["sums"].to_list()), axis=0)
    return pd.DataFrame({"fold": pdf["fold"].iloc[:1], "row": pdf["row"].iloc[:1], "sums": [total]})


def solve(total: np.ndarray, ridge: float) -> np.ndarray:
    """Ridge weights from [Z'Z, Z'y]; the last feature is the constant, and its entry counts the rows."""
    a, b = total[:, :-1], total[:, -1]
    penalty = ridge * max(1.0, a[-1, -1]) * np.ones(len(a))
    penalty[-1] = 1e-9
    return np.linalg.solve(a + np.diag(penalty), b)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted least-squares fit that never falls (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.empty(0)


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.clip(((raw + 0.5) * (BINS / 2)).astype(np.int64), 0, BINS - 1)


def _raw_bins(features: Features, weights: dict[int, np.ndarray]):
    """Labels counted by raw score, each row scored by the model that has not seen its fold."""
    schema = pa.schema([("bin", pa.int32()), ("good", pa.int64()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, docs = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
        for batch in batches:
            z = features.of(_stack(batch))
            y = batch.column("quality").to_numpy(zero_copy_only=False)
            folds = batch.column("fold").to_numpy(zero_copy_only=False)
            for fold in np.unique(folds):
                own = folds == fold
                at = _bin(z[own] @ weights[int(fold)])
                np.add.at(docs, at, 1)
                np.add.at(good, at, y[own])
        used = np.flatnonzero(docs)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(good[used]), pa.array(docs[used])], schema=schema)

    return run


@dataclass
class Model:
    """Ridge weights on Fourier features and the calibrated levels; without features every score is 0.5."""

    features: Features | None = None
    weights: np.ndarray | None = None
    centres: np.ndarray | None = None
    levels: np.ndarray | None = None

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.features is None:
            return np.full(len(stats), 0.5)
        raw = self.features.of(stats) @ self.weights
        # the raw score breaks ties on the calibrator's flat parts
        return 0.999 * np.interp(raw, self.centres, self.levels) + 0.001 * np.clip((raw + 0.5) / 2, 0, 1)


def _score(model: Model):
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([batch.column("id"), pa.array(model.score(_stack(batch)))], schema=schema)

    return run


def held_out(id_col) -> F.Column:
    """Rows whose labels are never learnt. A null id has no label and is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def fit_quality(measured: DataFrame, labels: DataFrame, id_col: str, features: int, ridge: float) -> Model:
    """The model fitted on the labelled rows of ``measured``: id and statistics of every row."""
    taught = (
        labels.where(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).cast("long").alias("label_id"))
        .agg(F.min("quality").cast("int").alias("quality"))
    )
    learn = materialise(
        measured.join(taught, F.col("id") == F.col("label_id")).select(
            "stats",
            "quality",
            (F.crc32(F.col("id").cast("string").cast("binary")) % FOLDS).cast("int").alias("fold"),
        ),
        "quality-learn",
    )
    moments = learn.agg(
        F.count("*").alias("n"),
        *[F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(N_STATS)],
        *[F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(N_STATS)],
    ).first()
    if not moments["n"]:
        return Model()
    mean = np.array([moments[f"m{i}"] for i in range(N_STATS)])
    scale = np.array([moments[f"s{i}"] for i in range(N_STATS)])
    z = Features(mean, np.where(scale > 1e-6, scale, 1.0), features, SEED)
    sums = (
        learn.mapInArrow(_normal_equations(z), "fold int, row int, sums array<double>")
        .groupBy("fold", "row")
        .applyInPandas(_add, "fold int, row int, sums array<double>")
        .toPandas()  # folds times features rows
    )
    by_fold = {int(fold): np.stack(own.sort_values("row")["sums"].to_list()) for fold, own in sums.groupby("fold")}
    total = sum(by_fold.values())
    unseen = {k: solve(total - own if len(by_fold) > 1 else total, ridge) for k, own in by_fold.items()}
    steps = (
        learn.mapInArrow(_raw_bins(z, unseen), "bin int, good long, docs long")
        .groupBy("bin")
        .agg(F.sum("good").alias("good"), F.sum("docs").alias("docs"))
        .orderBy("bin")
        .toPandas()  # at most BINS rows
    )
    weights = steps["docs"].to_numpy(float)
    levels = isotonic(steps["good"].to_numpy(float) / weights, weights)
    centres = (steps["bin"].to_numpy(float) + 0.5) / (BINS / 2) - 0.5
    return Model(z, solve(total, ridge), centres, levels)


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    features: int = FEATURES,
    ridge: float = RIDGE,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Score every whole text between 0 and 1, higher where label 1 is likelier.

    Statistics of each text go through random Fourier features. Labelled rows outside the held-out part
    add up to normal equations: a matrix of fixed size per partition and fold, summed by Spark; only the sums
    reach the driver. The folds are what is left of the id's CRC-32 by four. Isotonic calibration uses
    out-of-fold raw scores, counted over all labelled rows in a fixed number of steps. The model has learnt
    from text statistics alone: ids, sources, languages and labels are not inputs.

    Returns ``id_col, held_out, score, predicted`` (1 from ``threshold`` on). Null and empty texts are scored
    like any text; repeated rows get equal scores; an id labelled more than once counts once, good only
    if all its labels are; null labels and null ids do not teach; without any usable label every
    score is 0.5; other columns are ignored.
    """
    measured = materialise(
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
            _measure, "id long, stats array<float>"
        ),
        "quality-stats",
    )
    model = fit_quality(measured, labels, id_col, features, ridge)
    scored = measured.mapInArrow(_score(model), "id long, score double")
    return scored.select(
        F.col("id").alias(id_col),
        held_out(F.col("id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The rows whose text scores at least ``threshold``, with all their columns. See ``score_quality``.

    Rows are written once with their statistics beside them, so texts are measured once and never joined. Without labels
    nothing is known and all rows stay; so do, as in ``score_quality``, null texts that score high enough. Columns may
    have any names.
    """
    (stats,) = unused(docs.columns, "_stats")

    @F.pandas_udf("array<float>")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([np.array(statistics(t or "", split_words(t)), np.float32) for t in texts], dtype=object)
        forget_words()

    measured = materialise(docs.withColumn(stats, measure(F.col(text_col).cast("string"))), "quality-measured")
    narrow = measured.select(F.col(id_col).cast("long").alias("id"), F.col(stats).alias("stats"))
    model = fit_quality(narrow, labels, id_col, FEATURES, RIDGE)
    if model.features is None:
        return docs

    @F.pandas_udf("double")
    def score(rows: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(rows.to_list(), float)) if len(rows) else [], dtype="float64")

    return measured.where(score(F.col(stats)) >= threshold).drop(stats)
