"""The pipeline's stages on a small corpus: what goes, what stays, and that nothing is lost in between."""

import numpy as np
import pytest
from pyspark import Broadcast

import corpus_pipeline
from steepgrid.llm import ngram_join, packing

from test_llm_operators import brute_components

LINE = "this very line is found in many of the documents here"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(3000)]
    good = [(i, "\n".join(" ".join(rng.choice(words, 15)) for _ in range(8)) + ("\n" + LINE if i % 4 == 0 else "")) for i in range(80)]
    junk = [(100 + i, " ".join(f"{w}###" for w in rng.choice(words, 100))) for i in range(40)]
    near = [(200 + i, good[i][1].replace(" ", "\n" if i % 2 else " ", 3)) for i in range(8)]
    rows = [(i, t, "en", "s", len(t)) for i, t in good + junk + near]
    base = tmp_path_factory.mktemp("tables")
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kinds).repartition(3).write.parquet(f"{base}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in junk]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return str(base)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kinds = docs.columns, docs.dtypes
    kept = corpus_pipeline.quality(spark, docs, folder)
    ids = {r.doc_id for r in kept.collect()}
    assert ids >= set(range(80)) and not ids & set(range(100, 140))
    cleaned = corpus_pipeline.lines(spark, kept, folder)
    texts = {r.doc_id: r.text for r in cleaned.collect()}
    assert [i for i, t in texts.items() if LINE in t] == [0]
    assert set(texts) >= set(range(80))
    single = corpus_pipeline.near_duplicates(spark, cleaned, folder)
    rows = [(r.doc_id, r.text) for r in cleaned.collect()]
    want = {i for i, n, c in brute_components(rows) if not n or c == i}
    assert {r.doc_id for r in single.collect()} == want
    mixed = corpus_pipeline.mixture(spark, single, folder)
    assert mixed.columns == single.columns == cleaned.columns == kept.columns == columns
    assert mixed.dtypes == cleaned.dtypes == kinds
    assert {r.doc_id for r in mixed.collect()} <= want


def test_run_packs_what_the_stages_leave(spark, folder):
    pieces = corpus_pipeline.run(spark, folder)
    assert pieces.columns[:5] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    total = pieces.selectExpr("sum(length) as n", "max(offset + length) as m").first()
    assert total["n"] > 0 and total["m"] <= packing.WINDOW
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality classifier" and corpus_pipeline.ORACLE_SQL is None


def test_a_stage_deletes_what_earlier_ones_have_left(spark, folder, tmp_path):
    import os

    from steepgrid.session import scratch_dir

    def left():
        return {name for name in os.listdir(scratch_dir(spark)) if name.startswith(corpus_pipeline.SCOPE)}

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, folder)
    assert left() == {"stage-quality"}
    lazy = corpus_pipeline.lines(spark, kept, folder)  # still reads the first stage's tables
    assert left() == {"stage-quality", "stage-lines"}
    lazy.write.parquet(f"{tmp_path}/lines")
    corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/lines"), folder)
    assert left() == {"stage-near_duplicates"}


def test_the_driver_frees_the_map_of_repeated_shingles(spark, monkeypatch):
    freed, real = [], Broadcast.destroy
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *more: freed.append(len(self.value)) or real(self, *more))
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, None)], "doc_id long, text string")
    rows = ngram_join.join_by_shingles(docs).collect()
    assert sorted(tuple(r) for r in rows) == [(1, 2, 1), (2, 2, 1), (3, 0, 3)]
    assert freed == [(1 << ngram_join.MAP_BITS) // 8]
