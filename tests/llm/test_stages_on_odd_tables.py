"""Pipeline stages on tables whose columns have the operators' own names, and on hot keys."""

import numpy as np
from pyspark.sql import functions as F

from steepgrid.llm import line_dedup, mixing, ngram_join, packing, quality_model, words

NAMES = ["_of", "_gone", "n_lines", "n_removed", "_kept", "_least", "_place", "_copies", "_COPY", "_stats"]
LABELS = "doc_id long, quality int, toxic int"


def documents(spark):
    rng = np.random.default_rng(2)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(300)]
    texts = ["\n".join(" ".join(rng.choice(vocabulary, 9)) for _ in range(12)) for _ in range(40)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(50 + i, texts[0], "en") for i in range(3)]
    rows += [(60, None, None), (61, "", "en"), (None, texts[1], "de"), (62, "one two three four five six seven\n" * 3, "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def odd(docs):
    """The table with a column of every helper's name, holding 77."""
    return docs.select("*", *[F.lit(77).alias(n) for n in NAMES])


def same(plain, clashing, replaced=()):
    """Equal rows, and the odd columns as they were."""
    kept = [n for n in NAMES if n not in replaced]
    assert [c for c in clashing.columns if c in kept] == kept
    rows = clashing.collect()
    assert all(r[n] == 77 for r in rows for n in kept)
    assert sorted((tuple(r[c] for c in plain.columns) for r in rows), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_line_dedup(spark):
    docs = documents(spark)
    same(line_dedup.drop_near_lines(docs), line_dedup.drop_near_lines(odd(docs)), ("n_lines", "n_removed"))
    assert line_dedup.drop_near_lines(odd(docs)).columns.count("n_lines") == 1


def test_near_duplicates(spark):
    docs = documents(spark)
    plain = ngram_join.keep_one_of_each(docs)
    same(plain, ngram_join.keep_one_of_each(odd(docs)))
    assert plain.where("doc_id between 50 and 59").count() == 0 and plain.where("doc_id is null").count() == 1
    assert ngram_join.keep_one_of_each(docs.limit(0)).count() == 0


def labels(spark):
    rows = [(i, int(i % 3 > 0), int(i % 10 == 0)) for i in range(40)] + [(None, 1, 0), (60, None, None)]
    return spark.createDataFrame(rows, LABELS)


def test_mixing(spark):
    docs = documents(spark)
    same(mixing.mix_documents(docs, labels(spark)), mixing.mix_documents(odd(docs), labels(spark)))
    assert mixing.mix_documents(docs.limit(0), labels(spark)).count() == 0


def test_quality(spark):
    docs = documents(spark)
    plain = quality_model.keep_good(docs, labels(spark))
    same(plain, quality_model.keep_good(odd(docs), labels(spark)))
    # the same rows as by the scores of the operator itself
    scores = quality_model.score_quality(docs, labels(spark)).where("predicted = 1").select("doc_id").collect()
    assert sorted(map(str, scores)) == sorted(map(str, plain.select("doc_id").collect()))
    assert quality_model.keep_good(docs, labels(spark).limit(0)).count() == docs.count()
    assert quality_model.keep_good(docs.limit(0), labels(spark)).count() == 0


def test_equal_rows_are_packed_in_many_shards(spark):
    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one and the same").alias("text"))
    tokens = packing.pack_documents(docs.limit(1)).first().doc_tokens
    pieces = packing.pack_documents(docs, shard_tokens=1000 * tokens).select("sequence_id", "length")
    shards = pieces.groupBy((F.col("sequence_id") / (1 << 32)).cast("int").alias("shard")).agg(F.sum("length").alias("n")).collect()
    assert len(shards) >= 15 and max(r.n for r in shards) <= 2500 * tokens
    assert sum(r.n for r in shards) == 20_000 * tokens


def bm25(docs, idf, mean):
    """Score of every pair of documents, term by term."""
    scores = np.zeros((len(docs), len(docs)))
    for s, seed in enumerate(docs):
        for d, ids in enumerate(docs):
            for t in set(seed):
                tf = ids.count(t)
                scores[s, d] += idf[t] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(ids) / mean))
    return scores


def test_neighbours_are_those_of_plain_bm25():
    """The first window: the longest document, then the others by their score, until it is full."""
    rng = np.random.default_rng(8)
    docs = [rng.zipf(1.3, n) % 400 for n in rng.integers(60, 140, 30)]
    docs = [d.tolist() for d in docs]
    df = np.array([sum(t in d for d in docs) for t in range(400)])
    idf = np.log1p((len(docs) - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean = float(np.mean([len(d) for d in docs]))
    pieces = list(packing.pack_shard([np.array(d) for d in docs], idf, mean, 1024))
    seed = int(np.argmax([len(d) for d in docs]))
    score = bm25(docs, idf, mean)[seed]
    order = [seed] + [d for d in sorted(range(len(docs)), key=lambda d: -score[d]) if d != seed and score[d] > 0]
    first = [d for d, _, _, sequence, _ in pieces if sequence == 0]
    assert first == order[: len(first)] and sum(n for _, _, n, s, _ in pieces if s == 0) == 1024


def test_one_cache_lives_in_a_worker():
    first, second = {1: 1}, {2: 2}
    words.hold(first)
    words.hold(second)
    assert first == {} and second == {2: 2}
    words.hold(second)
    assert second == {2: 2}
    words._held.clear()
