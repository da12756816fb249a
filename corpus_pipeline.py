"""Documents to training sequences: quality, line dedup, near-duplicate documents, mixing, packing.

A stage's result is meant to be written before the next stage starts. A stage whose input no longer depends on what the other
stages have left in the scratch folder deletes that first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from steepgrid.llm import line_dedup, mixing, ngram_join, packing, quality_model
from steepgrid.session import drop_scratch, materialise, scratch_scope
from steepgrid.sources.tables import read_table

SCOPE = "stage-"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def apart(stage: Stage) -> Stage:
    """The stage with its intermediate tables in a folder of its own; those of the others go unless ``docs`` still reads them."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not any(f"/{SCOPE}" in file for file in docs.inputFiles()):
            for _, other in STAGES:
                if other.__name__ != stage.__name__:
                    drop_scratch(spark, SCOPE + other.__name__)
        with scratch_scope(SCOPE + stage.__name__):
            return stage(spark, docs, sf_dir)

    run_stage.__name__, run_stage.__doc__ = stage.__name__, stage.__doc__
    return run_stage


@apart
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_model.keep_good(docs, read_table(spark, "labels", sf_dir))


@apart
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines seen before go, and documents of which nothing is left; ``n_chars`` follows the text."""
    left = line_dedup.drop_near_lines(docs, exact_words=line_dedup.EXACT_WORDS)
    left = left.where((F.col("n_removed") == 0) | (F.col("text") != ""))
    count = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return left.withColumn("n_chars", count).select(*docs.columns)


@apart
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngram_join.keep_one_of_each(docs)


@apart
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their domains' target weights ask for."""
    return mixing.mix_documents(docs, read_table(spark, "labels", sf_dir))


@apart
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing to target weights", mixture),
    ("packing", sequences),
]

# SQL cannot express the models and searches of the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, "documents", sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
