"""Merkle manifest, language profiles and periodic runs against brute force, awkward rows included."""

import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from oracle import compare, connect
from steepgrid.llm import hyperdim, manifest, periodic, queries

SF = "/root/testdata/sf0.001"
DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
# names that the operators use inside or return
CLASHING = ["id", "place", "block", "size", "leaf", "path", "root", "tree", "runs", "best", "row", "held_out", "score", "profile"]


def with_clashes(docs):
    return docs.select("*", *[F.lit(77).alias(name) for name in CLASHING])


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


# --- manifest -----------------------------------------------------------------------------------------------------


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    def enc(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    return digest(*[enc(row[k]) for k in ("doc_id", "source", "lang", "n_chars", "text")])


def tree(leaves):
    """Root and every leaf's siblings, level by level."""
    proofs = [[] for _ in leaves]
    where = list(range(len(leaves)))
    nodes = leaves
    while len(nodes) > 1:
        for leaf, at in enumerate(where):
            run = range(at // 16 * 16, min(at // 16 * 16 + 16, len(nodes)))
            proofs[leaf].append(("".join(nodes[i] for i in run if i < at), "".join(nodes[i] for i in run if i > at)))
        nodes = [digest(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        where = [w // 16 for w in where]
    return nodes[0], proofs


def brute_manifest(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row["source"], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    parts, out = [], []
    for name in names:
        members = sorted(((r, leaf_of(r)) for r in groups[name]), key=lambda x: (x[0]["doc_id"] is not None, x[0]["doc_id"] or 0, x[1]))
        parts.append((members, *tree([leaf for _, leaf in members])))
    root, above = tree([subroot for _, subroot, _ in parts])
    for (members, subroot, proofs), upper in zip(parts, above):
        for (row, leaf), proof in zip(members, proofs):
            path = proof + upper
            out.append((row["doc_id"], row["source"], leaf, subroot, root, tuple(path), digest(*[s for p in path for s in p])))
    return sorted(out, key=str)


def manifest_rows(df):
    return sorted(
        (
            (r.doc_id, r.source, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.path), r.proof)
            for r in df.collect()
        ),
        key=str,
    )


def corpus(spark, sizes, odd=True):
    rows = [
        {"doc_id": i * 7 + k, "text": f"Text {i} of {name}", "lang": "en", "source": name, "n_chars": i}
        for k, (name, n) in enumerate(sizes.items())
        for i in range(n)
    ]
    if odd:
        rows += [
            {"doc_id": None, "text": "no id", "lang": None, "source": "b", "n_chars": None},
            {"doc_id": None, "text": None, "lang": None, "source": None, "n_chars": None},
            {"doc_id": 5, "text": "", "lang": "", "source": "", "n_chars": 0},
            {"doc_id": 6, "text": "Twice", "lang": "de", "source": "c", "n_chars": 5},
            {"doc_id": 6, "text": "Twice", "lang": "de", "source": "c", "n_chars": 5},
            {"doc_id": 6, "text": "Zürich ß", "lang": "de", "source": "c", "n_chars": 8},
            {"doc_id": 8, "text": "Ü" * 40_000, "lang": "de", "source": "É", "n_chars": 40_000},
        ]
    random.Random(3).shuffle(rows)
    return rows, spark.createDataFrame([tuple(r[f.name] for f in DOCS) for r in rows], DOCS)


@pytest.mark.parametrize(
    "sizes, levels",
    [
        ({"a": 1, "b": 16, "c": 17, "d": 257}, manifest.BLOCK_LEVELS),
        ({"a": 700, "b": 273, "c": 16, "d": 1, "e": 256}, 1),  # blocks of 16: up to three rounds
        ({f"s{i:03d}": 2 for i in range(290)}, 0),  # every leaf a block, three levels of groups
    ],
)
def test_manifest_equals_plain_trees(spark, sizes, levels):
    rows, docs = corpus(spark, sizes)
    got = manifest_rows(manifest.build_manifest(with_clashes(docs).repartition(5), block_levels=levels))
    assert got == brute_manifest(rows)


def test_manifest_of_one_source_and_of_nothing(spark):
    rows, docs = corpus(spark, {"only": 1}, odd=False)
    got = manifest.build_manifest(docs).collect()
    assert len(got) == 1 and got[0].root == got[0].subroot == got[0].leaf == leaf_of(rows[0]) and got[0].path == []
    assert manifest.build_manifest(docs.limit(0)).collect() == []


def test_manifest_shows_what_changed(spark):
    rows, docs = corpus(spark, {"a": 40, "b": 3})
    lowered = F.when(F.col("doc_id") % 2 == 0, F.lower("text")).otherwise(F.col("text"))
    proven = manifest.build_manifest(docs, observed={"text": lowered}, block_levels=1)
    for r in proven.withColumn("again", manifest.fold(F.col("observed"))).collect():
        assert r.again == r.folded and (r.folded == r.root) == (r.leaf == r.observed)
        assert r.leaf == r.observed or r.doc_id % 2 == 0
    assert {r.leaf == r.observed for r in proven.collect()} == {True, False}


def test_merkle_query_equals_sql(spark):
    name = "op11_merkle_manifest"
    problem, _, _ = compare(spark, connect(SF), name, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert problem is None


# --- languages ----------------------------------------------------------------------------------------------------

VOICES = {"ab": "abcde", "uv": "uvwxy", "gr": "αβγδε", "cj": "語言模型字"}


def spoken(rng, lang, n=40):
    return " ".join("".join(rng.choices(VOICES[lang], k=rng.randint(2, 6))) for _ in range(n))


def speech(spark, extra=()):
    rng = random.Random(7)
    rows = [(i, spoken(rng, lang), lang) for i, lang in enumerate(list(VOICES) * 15)]
    rows += list(extra)
    return rows, spark.createDataFrame([(i, t, lang, "src", 0) for i, t, lang in rows], DOCS)


def plain_vector(text):
    """A text's bundle, n-gram by n-gram."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    codes = [0] + [c for word in letters for c in [*map(ord, word), 0]]
    signs = {c: 1 - 2 * np.unpackbits(hyperdim.letter_vectors(np.array([c], np.uint32))[0]).astype(int) for c in set(codes)}
    total = np.zeros(hyperdim.WIDTH, int)
    for i in range(len(codes) - 2):
        total += signs[codes[i]] * np.roll(signs[codes[i + 1]], 8) * np.roll(signs[codes[i + 2]], 16)
    return total


def test_bundles_equal_plain_sums():
    texts = ["Ab ba", "x", "über Straße 12 tag", "語言 模型", "a" * 3000]
    letters = [hyperdim.letters_of(t) for t in texts]
    sums, totals = hyperdim.bundles(letters)
    for text, found, total, codes in zip(texts, sums, totals, letters):
        assert total == len(codes) - 2 and (found == plain_vector(text)).all()


def test_a_long_text_is_summed_in_pieces(monkeypatch):
    letters = [hyperdim.letters_of(t) for t in ("eine lange Geschichte von vielen Dingen " * 9, "kurz", "y")]
    whole = hyperdim.bundles(letters)
    monkeypatch.setattr(hyperdim, "JOINT_LETTERS", 50)
    monkeypatch.setattr(hyperdim, "JOINT_GRAMS", 7)
    cut = hyperdim.bundles(letters)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


ODD = [(900, None, "ab"), (901, "", "ab"), (902, "12 34 .", "uv"), (903, "abcde", None), (None, "uvw xyv", "ab"), (904, "語言", "cj")]


def test_languages(spark):
    rows, docs = speech(spark, [*ODD, (905, "abc " * 60_000, None), (906, "dcb abe", None), (906, "dcb abe", None)])
    got = [r for r in hyperdim.predict_language(with_clashes(docs).repartition(3)).collect()]
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    truth = {i: lang for i, _, lang in rows[:60]}
    for r in got:
        assert r.held_out == (r.doc_id is not None and crc(r.doc_id) % 3 == 1)
        if r.doc_id in truth:
            assert r.lang_pred == truth[r.doc_id]
    by_id = {r.doc_id: r.lang_pred for r in got}
    assert [by_id[i] for i in (900, 901, 902, 903, None, 904, 905, 906)] == ["und", "und", "und", "ab", "uv", "cj", "ab", "ab"]


def test_held_out_languages_do_not_teach(spark):
    rows, docs = speech(spark)
    changed = F.when(hyperdim.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang"))
    plain = sorted(hyperdim.predict_language(docs).collect())
    assert sorted(hyperdim.predict_language(docs.withColumn("lang", changed)).collect()) == plain
    assert sorted(hyperdim.predict_language(docs.repartition(7)).collect()) == plain  # order changes nothing


def test_languages_without_labels_and_without_rows(spark):
    _, docs = speech(spark)
    blind = hyperdim.predict_language(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in blind.collect()} == {("und", 0.0)}
    assert hyperdim.predict_language(docs.limit(0)).collect() == []


def test_more_languages_than_one_pass(spark, monkeypatch):
    _, docs = speech(spark, ODD)
    one = sorted(hyperdim.predict_language(docs).collect(), key=str)
    monkeypatch.setattr(hyperdim, "PROFILES", 3)
    several = sorted(hyperdim.predict_language(docs).collect(), key=str)
    assert [r[:3] for r in one] == [r[:3] for r in several]
    assert np.allclose([r.score for r in one], [r.score for r in several])


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.01"), reason="test tables are not there")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    found = queries.op12_hyperdim_language(spark, "/root/testdata/sf0.01")
    right = found.where("held_out").join(docs, "doc_id").where("lang is not null and lang_pred != 'und'")
    share = right.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert share > 0.98


# --- runs ---------------------------------------------------------------------------------------------------------


def brute_runs(words):
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            period = words[i : i + q]
            if j - i + q >= max(24, 3 * q) and not any(
                q % d == 0 and period == period[:d] * (q // d) for d in range(1, q)
            ):
                out.append((i, j - i + q, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def repeated(rng, n, kinds, times):
    words = [b"%d" % rng.randrange(kinds) for _ in range(n)]
    for _ in range(times if n > 3 else 0):
        start = rng.randrange(n)
        period = rng.randint(1, max(1, (n - start) // 3))
        for i in range(start, rng.randint(start, n)):
            words[i] = words[start + (i - start) % period]
    return words


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**9))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    texts = [
        repeated(rng, rng.choice([0, 1, 5, 30, 100, 300]), rng.choice([1, 2, 3, 50]), rng.randint(0, 4)) for _ in range(rng.randint(1, 8))
    ]
    assert periodic.find_runs(texts) == [brute_runs(t) for t in texts]


def test_a_long_period_and_a_square_free_text():
    rng = random.Random(5)
    long = repeated(rng, 9000, 10**6, 0)
    long[1000:8000] = (long[1000:1000 + 1777] * 4)[:7000]
    assert periodic.find_runs([long, [b"w"] * 50_000]) == [[(1000, 7000, 1777)], [(0, 50_000, 1)]]


def brute_digest(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), crc(doc_id) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    text_of_runs = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *tail, sha256(text_of_runs.encode()).hexdigest(), sha256(kept).hexdigest())


def test_run_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, " ".join(w.decode() for w in repeated(rng, rng.choice([3, 40, 200]), rng.choice([2, 40]), 2))) for i in range(120)]
    rows += [
        (500, None), (501, ""), (502, " \n\t"), (503, "one"), (None, "a b " * 30), (504, "É é x\n" * 20), (505, "A a " * 9),
        (506, "same same " * 20), (506, "same same " * 20), (507, "x " * 30_000),
        *[(600 + i, "many \t words here\n" * 12) for i in range(40)],
    ]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    with_clashes(docs).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((brute_digest(i, t) for i, t in rows), key=str)


def test_runs_of_an_empty_table_and_of_other_ids(spark):
    docs = spark.createDataFrame([("k", "go on " * 15)], "doc_id string, text string")
    assert periodic.periodic_runs(docs.limit(0)).collect() == []
    row = periodic.periodic_runs(docs).first()
    assert (row.doc_id, row.n_words, [tuple(r) for r in row.runs], row.collapsed) == ("k", 30, [(0, 30, 2)], "go on")
