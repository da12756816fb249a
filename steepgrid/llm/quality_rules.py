"""Quality rules whose cutoffs keep the share of falsely rejected good documents under a proven bound."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from steepgrid.llm.text_stats import base_counts
from steepgrid.llm.words import batched, forget_words, rows_of, split_words
from steepgrid.session import materialise

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
RISK = 0.03  # largest share of good documents that a rule may reject in a stratum
ERROR = 0.05  # chance that any of all rules and strata breaks that bound
PENALTY = 20  # caught bad documents that one rejected good document must buy
SHARES = [0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.125, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02]
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
LENGTHS = [64, 48, 32, 24, 20, 18, 16, 15, 14, 13, 12, 11, 10]
# A rule rejects a document whose value is at or over the cutoff; cutoffs from the loosest on, fixed before any data is seen.
RULES = {
    "symbols": SHARES,
    "lines": SHARES,
    "repeats": SHARES,
    "capitals": SHARES,
    "marks": SHARES,
    "word_length": LENGTHS,
}

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_ROWS = pa.schema(
    [("id", pa.int64()), ("stratum", pa.string())]
    + [(c, pa.int64()) for c in _COUNTS]
    + [(f"bin_{r}", pa.int32()) for r in RULES]
)


def measures(text: str, counts: tuple[int, int, int, int, int, int]) -> dict[str, float]:
    """The value each rule looks at."""
    words, chars, symbols, lines, repeated, repeats = counts
    raw = text.encode("utf-8", "surrogatepass")
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return {
        "symbols": symbols / max(1, words),
        "lines": repeated / max(1, lines),
        "repeats": repeats / max(1, words),
        "capitals": capitals / max(1, chars),
        "marks": (text.count("!") + text.count("?")) / max(1, words),
        "word_length": chars / max(1, words),
    }


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # negated and ascending, so that searchsorted counts the cutoffs at or under a value
    grids = {rule: -np.array(cutoffs, float) for rule, cutoffs in RULES.items()}

    def rows():
        for key, text, stratum in rows_of(batches, "id", "text", "stratum"):
            text = text or ""
            counts = base_counts(text, split_words(text))
            values = measures(text, counts)
            # number of leading (looser) cutoffs that do not reject the document
            loose = [int(np.searchsorted(grids[r], -values[r], "left")) for r in RULES]
            yield (key, stratum, counts[0], counts[1], counts[2], counts[4], counts[5], *loose)

    yield from batched(rows(), _ROWS)
    forget_words()


def binomial_upper_holds(rejected: int, total: int, risk: float, error: float) -> bool:
    """Whether ``rejected`` or fewer of ``total`` has probability at most ``error`` at rejection rate ``risk``.

    This is the exact binomial test that inverts the Clopper-Pearson upper bound: it holds if and only if
    the bound at confidence 1 - error is at most ``risk``.
    """
    if rejected >= total:
        return False
    term = total * math.log1p(-risk)
    odds, log_sum = math.log(risk) - math.log1p(-risk), term
    for k in range(1, rejected + 1):
        term += math.log(total - k + 1) - math.log(k) + odds
        log_sum = max(log_sum, term) + math.log1p(math.exp(-abs(log_sum - term)))
        if log_sum > math.log(error):
            return False
    return log_sum <= math.log(error)


def choose_cutoff(good: np.ndarray, bad: np.ndarray, risk: float, error: float, penalty: float) -> int:
    """Index of the cutoff, or -1. ``good[j]`` and ``bad[j]`` count documents that cutoff j rejects.

    Cutoffs are tested from the loosest on, each at the full error, until the first fails (fixed
    sequence: the chance that any wrong one passes stays under the error). Among those that passed
    the one that catches most is taken, a rejected good document weighing ``penalty`` bad ones;
    the loosest on ties, none if nothing is caught.
    """
    total_good = int(good[-1])  # the last entry counts all
    best, best_gain = -1, 0.0
    for j in range(len(good) - 1):
        if not binomial_upper_holds(int(good[j]), total_good, risk, error):
            break
        gain = float(bad[j]) - penalty * float(good[j])
        if gain > best_gain:
            best, best_gain = j, gain
    return best


def _chooser(risk: float, error: float, penalty: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, object] = {"known": pdf["stratum"].iloc[0]}
        for rule, cutoffs in RULES.items():
            own = pdf[pdf["rule"] == rule]
            counts = np.zeros((2, len(cutoffs) + 1), np.int64)
            np.add.at(counts, (own["quality"].to_numpy(), own["bin"].to_numpy()), own["docs"].to_numpy())
            bad, good = counts.cumsum(axis=1)
            chosen = choose_cutoff(good, bad, risk, error, penalty)
            out[f"cut_{rule}"] = len(cutoffs) if chosen < 0 else chosen
        return pd.DataFrame([out]).assign(known=lambda d: d["known"].where(d["known"].notna(), None))

    return run


def filter_by_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    risk: float = RISK,
    error: float = ERROR,
    penalty: float = PENALTY,
) -> DataFrame:
    """Base counts of every document and whether the rules keep it.

    Labelled documents (quality 1 is good, 0 is bad) are the holdout. For every stratum and rule the
    rejected good and bad documents of each cutoff are counted over all of them; a cutoff is usable when
    the exact binomial upper bound of its false rejection rate is at most ``risk``, at an error divided by
    the number of rules times strata (Bonferroni), see ``choose_cutoff``. A stratum with too few labels
    to prove anything has no cutoffs, and its documents are kept.

    Returns ``id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept``, then the
    stratum and the rules that rejected (``failed_rules``). Null text counts as empty and fails the base
    rule; a null stratum is a stratum of its own; an id labelled more than once is good only if all its labels are;
    null labels and null ids do not teach; repeated rows are judged one by one; without labels only
    the base rule rejects; other columns are ignored.
    """
    measured = materialise(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            F.col(text_col).cast("string").alias("text"),
            F.col(stratum_col).cast("string").alias("stratum"),
        ).mapInArrow(
            _measure,
            "id long, stratum string, "
            + ", ".join(f"{c} long" for c in _COUNTS)
            + ", "
            + ", ".join(f"bin_{r} int" for r in RULES),
        ),
        "rule-measures",
    )
    taught = (
        labels.where(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("label_id"))
        .agg(F.min("quality").cast("int").alias("quality"))
    )
    pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"bin_{r}").alias("bin")) for r in RULES]))
    counts = (
        measured.join(taught, F.col("id") == F.col("label_id"))
        .select("stratum", "quality", pairs.alias("p"))
        .groupBy("stratum", "p.rule", "quality", "p.bin")
        .agg(F.count("*").alias("docs"))
    )
    counts = materialise(counts, "rule-counts")
    strata = max(1, counts.select("stratum").distinct().count())
    cuts = counts.groupBy("stratum").applyInPandas(
        _chooser(risk, error / (strata * len(RULES)), penalty),
        "known string, " + ", ".join(f"cut_{r} int" for r in RULES),
    )
    cuts = materialise(cuts, "rule-cutoffs")
    # a cutoff rejects what fewer looser cutoffs than its index leave alone; without one nothing is rejected
    failed = F.filter(
        F.array(
            *[
                F.when((F.col(f"cut_{r}") < len(RULES[r])) & (F.col(f"bin_{r}") <= F.col(f"cut_{r}")), F.lit(r))
                for r in RULES
            ]
        ),
        lambda r: r.isNotNull(),
    )
    base_failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return (
        measured.join(cuts, F.col("stratum").eqNullSafe(F.col("known")), "left")
        .withColumn("failed_rules", failed)
        .withColumn("base_failed", base_failed)
        .select(
            F.col("id").alias(id_col),
            *_COUNTS,
            "base_failed",
            (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"),
            F.col("stratum"),
            "failed_rules",
        )
    )
