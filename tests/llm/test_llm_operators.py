"""Operators of the llm subpackage against brute force, on small tables that hold the awkward cases."""

import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F, types as T
from tokenizers import Tokenizer

from steepgrid.llm import (
    attention, cover_tree, extraction, language_model, line_dedup, linking, mixing, ngram_join, packing, quality_model,
    quality_rules, queries, sharding, topk, words,
)
from steepgrid.llm.text_stats import base_counts
from steepgrid.llm.words import split_words

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("size", T.StringType()),  # clashes with names that operators use inside
        T.StructField("sid", T.StringType()),
        T.StructField("shard", T.IntegerType()),
    ]
)
LABELS = "doc_id long, quality int, toxic int"


def corpus():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(400)]

    def text(n):
        return "\n".join(" ".join(rng.choice(words, 12)) for _ in range(max(1, n // 12)))

    base = text(240)
    rows = [(i, text(int(rng.integers(24, 400)))) for i in range(60)]
    rows += [(100 + i, base) for i in range(12)]  # exact copies
    for i in range(12):  # near copies
        lines = base.split("\n")
        lines[i] = lines[i].replace(lines[i].split()[3], "zzzz", 1)
        rows.append((200 + i, "\n".join(lines)))
    rows += [(300 + i, " ".join(f"{w}***" for w in rng.choice(words, 90))) for i in range(30)]  # junk
    rows += [
        (400, None),
        (401, ""),
        (402, " \n\t "),
        (403, "one two"),
        (404, "ONE two"),
        (405, "é é É . ,"),
        (None, base),
        (None, None),
        (406, text(12_000)),
        (406, "same id, other text"),
        (407, "twice the same row"),
        (407, "twice the same row"),
    ]
    return [(i, t, "en" if n % 3 else None, "x", "y", 7) for n, (i, t) in enumerate(rows)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    known = [(r[0], 0 if 300 <= r[0] < 400 else 1, 0) for r in ROWS if r[0] is not None and r[0] < 400 and r[0] % 2 == 0]
    return spark.createDataFrame(known + [(None, 1, 0), (1, None, None), (2, 1, 0)], LABELS)


def nosuch(spark):
    return spark.createDataFrame([], LABELS)


def key(row):
    return tuple((x is not None, x) if not isinstance(x, (list, type(None))) else (False, 0) for x in row)


# 1 packing


def test_packing_is_an_exact_partition_of_all_ids(docs, nothing):
    got = packing.pack_documents(docs, window=256, shard_tokens=4000).collect()
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    want = Counter()
    for r in ROWS:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want[r[0], len(ids)] += len(ids)
    have = Counter()
    ids_of = defaultdict(list)
    for r in ROWS:
        ids_of[r[0]].append(np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4"))
    for p in got:
        have[p.doc_id, p.doc_tokens] += p.length
        some = [ids[p.start : p.start + p.length] for ids in ids_of[p.doc_id] if len(ids) == p.doc_tokens]
        assert p.ids_crc32 in {zlib.crc32(x.tobytes()) for x in some}
    assert have == want
    by_sequence = defaultdict(list)
    for p in got:
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for pieces in by_sequence.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end & (end - 1) == 0 and end <= 256
    assert packing.pack_documents(nothing).count() == 0


def test_neighbours_share_a_window():
    rng = np.random.default_rng(0)
    one, two = rng.integers(0, 50, (6, 100)), rng.integers(50, 100, (6, 100))
    shard = [x for pair in zip(one, two) for x in pair]
    pieces = list(packing.pack_shard(shard, np.ones(100, np.float32), 100.0, 200))
    together = defaultdict(set)
    for d, _, _, sequence, _ in pieces:
        together[sequence].add(d % 2)
    assert all(len(kinds) == 1 for kinds in together.values())


def test_chunks_encode_like_whole_texts():
    odd = ["<|endoftext|> A<|EndOfText|>b", "İstanbul ΣΑΣ. it's I'LL don't. foo).,bar a.b. 12.5, \x0b x\x85y é ́x .", "", "!!  \n\n .. ,"]
    cache = packing.chunk_ids(packing.TOKENIZER)
    got = packing.encode_texts(cache, odd, None)
    assert [x.tolist() for x in got] == [cache.tokenizer.encode(t, add_special_tokens=False).ids for t in odd]


# words


def test_words_hash_alike_wherever_they_stand():
    rng = np.random.default_rng(2)
    letters = np.array(list("aAbz\u00e9 \t\n\x0b\x0c\r\x1c\x85."))
    texts = ["".join(rng.choice(letters, n)) for n in (0, 1, 7, 80, 4000)] + [None, "", " \t"]
    texts += ["y" * 700_000 + " tail", "a B " * 200_000]  # longer than one piece
    known, back = {}, {}
    for text, hashes in zip(texts, words.hashed_texts(texts), strict=True):
        for word, value in zip(words.lower_words(text), hashes.tolist(), strict=True):
            assert known.setdefault(word, value) == value and back.setdefault(value, word) == word


def test_parity_maps_rule_out_no_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(400) < keep], rng.integers(0, 1 << 63, more).astype(np.uint64)]))
            for keep in (0.6, 0.85, 0.95, 1.0) for more in (0, 5, 60, 700) for _ in range(3)]
    for percent in (30, 75):
        unit = [(1, 0, asks, i, i, len(x), ngram_join.parity(x)) for asks in (True, False) for i, x in enumerate(sets)]
        names = ["unit", "part", "asks", "sid", "label", "n", "parity"]
        batch = pa.record_batch([pa.array(c) for c in zip(*unit)], names=names)
        kept = {(r["sid"], r["asks"]) for b in ngram_join._plausible(percent)(iter([batch])) for r in b.to_pylist()}
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                both = len(np.intersect1d(x, y))
                if i != j and 100 * both >= percent * (len(x) + len(y) - both):
                    assert (i, True) in kept and (j, False) in kept


# 2 top-k


def brute_top(rows, k, every):
    valid = [
        (i, [int(np.floor(64 * float(x))) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = set()
    for i, v in valid:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in valid if j != i)[:k]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)}
    return out


def test_top_products_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(1000 + i, rows[20][1]) for i in range(80)]  # a crowd of equal vectors, ties
    rows += [(2000, None), (2020, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2040, [float("nan")] * 6), (2060, [float("inf")] * 6), (None, rows[0][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = {tuple(r) for r in topk.top_products(frame, block=64).collect()}
    assert got == brute_top(single, 20, 20)
    assert topk.top_products(frame.limit(0)).count() == 0
    few = topk.top_products(frame.where("vec_id < 3"))
    assert {tuple(r) for r in few.collect()} == brute_top(single[:3], 20, 20)


def test_tree_bounds_cover_their_rows():
    rng = np.random.default_rng(2)
    tree = cover_tree.build(rng.integers(-50, 50, (900, 5)), np.arange(900))
    for a, b, c, r, children in zip(tree.first, tree.last, tree.centres, tree.radii, tree.children):
        assert np.sqrt(((tree.rows[a:b] - c) ** 2).sum(axis=1)).max() <= r + 1e-9
        assert not children or sum(tree.last[x] - tree.first[x] for x in children) == b - a


def test_two_trees_meet_in_few_products(monkeypatch):
    rng = np.random.default_rng(7)
    rows = rng.integers(-64, 64, (3000, 32))
    rows[500:1100] = rows[500]  # ties, more than k of them
    ids = rng.permutation(3000)
    one, two = cover_tree.build(rows[:1500], ids[:1500]), cover_tree.build(rows[1500:], ids[1500:])
    met, leaves = [], cover_tree._leaves
    monkeypatch.setattr(cover_tree, "_leaves", lambda *a: (met.append(1), leaves(*a)))
    for every, most in ((20, 300), (2, 10_000)):
        q = cover_tree.queries_of(one, one.ids % every == 0, 20)
        met.clear()
        for tree in (one, two):
            cover_tree.search(q, tree)
        assert len(met) < most  # all queries of a small block meet a node of rows in one product
        for own, scores, found, row in zip(q.ids, q.scores, q.found, q.rows):
            every_score = sorted((-int(s), int(i)) for s, i in zip(rows @ row, ids) if i != own)[:20]
            assert every_score == list(zip((-scores).astype(int).tolist(), found.tolist()))


# 3 sharding


def test_shards_are_contiguous_and_even(docs, nothing):
    got = sharding.shard_by_bytes(docs, shards=5).collect()
    assert sorted(key((r.doc_id, r["size"], r.text_crc32)) for r in got) == sorted(
        key((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode()))) for r in ROWS
    )
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in got)
    assert max(sizes.values()) - sum(sizes.values()) / 5 <= largest
    assert sharding.shard_by_bytes(nothing).count() == 0


def test_small_groups_of_equal_texts_stay_together(docs):
    got = sharding.shard_by_bytes(docs, shards=3, whole_share=0.5).where("doc_id between 100 and 111")
    assert got.select("shard").distinct().count() == 1


# 4 and 5 quality


def test_quality_model_on_held_out_rows(spark, docs, labels, nothing):
    got = quality_model.score_quality(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.predicted == (r.score >= 0.7)
        if r.doc_id is not None and r.doc_id < 100:
            assert r.predicted == 1
        if r.doc_id is not None and 300 <= r.doc_id < 400:
            assert r.predicted == 0
    assert quality_model.score_quality(nothing, labels).count() == 0
    assert {r.score for r in quality_model.score_quality(docs, nosuch(spark)).collect()} == {0.5}
    kept = {r.doc_id for r in quality_model.keep_good(docs, labels).collect()}
    assert kept >= set(range(60)) and not kept & set(range(300, 330))


def test_isotonic_never_falls():
    rng = np.random.default_rng(0)
    fit = quality_model.isotonic(rng.random(50), rng.random(50) + 0.1)
    assert (np.diff(fit) >= 0).all()


def test_base_counts_by_brute_force():
    text = "a b c\na b c\n\n x a b c # | y z"
    words = split_words(text)
    assert words == [w.encode() for w in ["a", "b", "c", "a", "b", "c", "x", "a", "b", "c", "#", "| y z"]]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    assert base_counts(text, words) == (12, 16, 2, 3, 1, len(marked))


def test_rules_keep_good_documents(spark, docs, labels, nothing):
    got = quality_rules.filter_by_rules(docs, labels, risk=0.3, error=0.5).collect()
    assert len(got) == len(ROWS)
    assert all(not r.kept for r in got if r.base_failed)
    assert all(r.kept or r.base_failed for r in got if r.doc_id is not None and r.doc_id < 100)
    assert any(not r.kept and not r.base_failed for r in got if r.doc_id is not None and 300 <= r.doc_id < 400)
    unknown = quality_rules.filter_by_rules(docs, nosuch(spark)).collect()
    assert all(r.kept != r.base_failed for r in unknown)
    assert quality_rules.filter_by_rules(nothing, labels).count() == 0


def test_exact_binomial_bound():
    from math import comb

    for total in (20, 200):
        for rejected in (0, 1, 5):
            tail = sum(comb(total, k) * 0.05**k * 0.95 ** (total - k) for k in range(rejected + 1))
            assert quality_rules.binomial_upper_holds(rejected, total, 0.05, 0.05) == (tail <= 0.05)
    assert not quality_rules.binomial_upper_holds(0, 0, 0.05, 0.05)
    assert quality_rules.choose_cutoff(np.array([0, 0, 400]), np.array([3, 9, 20]), 0.03, 0.05, 20) == 1


# 6 mixing


def test_mixing_meets_its_targets(spark, docs, nothing):
    known = [(r[0], 0 if 300 <= r[0] < 400 else 1, 0) for r in ROWS if r[0] is not None and r[0] < 400]
    labels = spark.createDataFrame(known, LABELS)
    targets = {"clean": 0.9, "low": 0.08, "toxic": 0.02}
    got = mixing.mix_rates(docs, labels, targets).collect()
    assert len(got) == len(ROWS) and all(r.rate >= 0 for r in got)
    totals = np.array([sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in got) for d in ("clean", "low")])
    assert totals[1] / totals[0] == pytest.approx(0.08 / 0.9, rel=1e-2)
    assert mixing.mix_rates(nothing, labels).count() == 0
    assert mixing.mix_documents(docs, nosuch(spark)).columns == docs.columns


def test_marks_are_counted_where_the_texts_arrive():
    """Once, in the text's own language: neither marks nor a second count for all languages are shuffled."""
    rows = [("en", 0, "one two one"), ("en", 2, "two"), ("fr", 1, "deux"), (None, 0, "two"), (None, 1, None)]
    batch = pa.record_batch([pa.array(c) for c in zip(*rows)], names=["lang", "domain", "text"])
    got, want = Counter(), Counter()
    for some in mixing._count_marks(iter([batch])):
        for r in some.to_pylist():
            got.update({(r["lang"], r["bucket"], d): r[name] for d, name in enumerate(mixing.DOMAINS) if r[name]})
    for lang, domain, text in rows:
        want.update((lang, int(m), domain) for m in [*mixing.marks(text)[1], mixing.MARKS])
    assert got == want


def test_marks_of_a_smaller_language_tell(spark):
    rng = np.random.default_rng(6)
    stems = ["".join(rng.choice(list("abcdefgh"), 4)) for _ in range(300)]

    def text(toxic):
        words = list(rng.choice(stems, 60))
        return " ".join([*words, *toxic])

    rows = [(i, text(["idiot"] * (i < 200)), "en", int(i < 200)) for i in range(1200)]
    # each toxic word comes once, only its beginning repeats, and in fewer than 5 % of all toxic documents
    rows += [(2000 + i, text([f"bomentex{i}q{j}" for j in range(3)] if i < 9 else []), "es", int(i < 9)) for i in range(150)]
    frame = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    known = spark.createDataFrame([(r[0], 1, r[3]) for r in rows if r[0] != 2000], LABELS)
    got = {r.doc_id: r.p_toxic for r in mixing.mix_rates(frame, known).collect()}
    assert all((got[r[0]] > 0.5) == bool(r[3]) for r in rows)


# 7 line dedup


def words_of(line):
    return tuple(line.encode().split())


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def test_line_dedup_equals_brute_force(spark, nothing):
    rng = np.random.default_rng(9)
    words = list("abcdefghij")
    lines = [" ".join(rng.choice(words, int(rng.integers(4, 10)))) for _ in range(60)]
    for line in lines[:20]:
        parts = line.split()
        lines += [" ".join(parts[1:]), " ".join([*parts[:2], "q", *parts[2:]]), " ".join([*parts[:-1], "r"]), line]
    order = rng.permutation(len(lines))
    rows = [(int(i), "\n".join(lines[j] for j in order[i * 5 : i * 5 + 5])) for i in range(28)]
    rows += [(50, None), (51, ""), (None, lines[0]), (52, lines[3]), (52, lines[3]), (53, " ".join(rng.choice(words, 3000)))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_hash", F.lit("clash"))
    placed = [(1 << 63 if i is None else i, k, i, t, words_of(x)) for i, t in rows if t is not None for k, x in enumerate(t.split("\n"))]
    first = {}
    for p in sorted(placed, key=lambda p: p[:2]):
        if len(p[4]) >= 6:
            first.setdefault(p[4], p[:2])
    late = {w for w in first if any(first[v] < first[w] and near(v, w) for v in first)}
    want = []
    for i, t in rows:
        if t is None:
            want.append((i, None, 0, 0))
            continue
        keep = [
            x
            for k, x in enumerate(t.split("\n"))
            if len(words_of(x)) < 6
            or (words_of(x) not in late and first[words_of(x)] == (1 << 63 if i is None else i, k))
        ]
        want.append((i, "\n".join(keep), len(t.split("\n")), len(t.split("\n")) - len(keep)))
    got = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in line_dedup.drop_near_lines(frame).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert line_dedup.drop_near_lines(nothing).count() == 0
    plan = line_dedup.drop_near_lines(frame)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_text_is_hashed_and_split_once(spark):
    """A step per line that reads the whole text would take minutes here."""
    lines = [f"long line {i}" for i in range(40_000)]
    rows = [(1, "\n".join([*lines, lines[7], "a\tb\x0bc", "a b\x0cc", "a \r b  c\t", "\t \x0b"]))]
    began = time.monotonic()
    (got,) = line_dedup.drop_near_lines(spark.createDataFrame(rows, "doc_id long, text string"), exact_words=1).collect()
    assert time.monotonic() - began < 60
    assert got.text == "\n".join([*lines, "a\tb\x0bc", "\t \x0b"]) and (got.n_lines, got.n_removed) == (40_005, 3)


def test_exact_repeats_of_short_lines_go(spark, tmp_path):
    rows = [
        (1, "All rights reserved.\n\nx"),
        (2, "a b c d e f g\n All  rights reserved.\n\n"),
        (3, "x\nAll rights kept.\nx y"),
        (4, "b c d e f\nb c d e f"),
    ]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.n_removed) for r in queries.op7_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {
        1: ("All rights reserved.\n\nx", 0),
        2: ("a b c d e f g\n\n", 1),  # blank lines are no repeats
        3: ("All rights kept.\nx y", 1),
        4: ("b c d e f", 1),  # a near copy only of a line that is long enough
    }


# 8 extraction

PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=x>m</a>
<li><a href=y>n</a></ul></nav><!-- <p>no</p> --><div class="ad">buy</div><article><h1>Head &amp; line</h1><p><b>One<br><p>two
  three&nbsp;&eacute; <i>four</i></p><p>a &lt; b</article><aside>side</aside><footer>&copy; f</footer></body></html>"""


def test_blocks_and_weak_labels():
    blocks = extraction.blocks_of(PAGE)
    main = [b.text for b, keep in zip(blocks, extraction.weak_labels(blocks)) if keep]
    assert main == ["Head & line", "One", "two three é four", "a < b"]
    assert extraction.blocks_of(None) == [] and extraction.blocks_of("1 < 2 <") == extraction.blocks_of("1 < 2 <")


def test_extraction(spark):
    rows = [(i, f"u{i}", PAGE.replace("One", f"Text {i}")) for i in range(40)] + [(90, None, None), (91, "u", ""), (None, "u", PAGE)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in extraction.extract_main_text(frame).collect()}
    for i in range(40):
        text = f"Head & line\nText {i}\ntwo three é four\na < b"
        assert got[i, f"u{i}"] == (text, len(text))
    assert got[90, None] == ("", 0) == got[91, "u"]
    assert extraction.extract_main_text(frame.limit(0)).count() == 0


# 9 language model


def test_base_scores_by_brute_force(docs, nothing):
    got = language_model.score_texts(docs, frequent=50, sample=200, epochs=1).collect()
    counts = Counter()
    for r in ROWS:
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10:
            counts.update([*(r[1] or "").encode().lower().split(), "end"])
    n, v = sum(counts.values()), len(counts)
    want = []
    for r in ROWS:
        tokens = [*(r[1] or "").encode().lower().split(), "end"]
        base = sum(np.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)
        out = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0
        want.append((r[0] or -1, out, len(tokens), sum(counts[t] > 0 for t in tokens), n, round(base, 6)))
    have = [(r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got]
    assert sorted(have) == sorted(want)
    assert all(r.score < 0 for r in got)
    assert language_model.score_texts(nothing).count() == 0


def small_model():
    rng = np.random.default_rng(3)
    counts = rng.integers(1, 50, 41).astype(float)
    v = attention.vocabulary(counts, rng.random(41) < 0.5)
    before = rng.integers(0, 42, 300)
    ids = rng.integers(0, 41, 300)
    key, number = np.unique(before << 32 | ids, return_counts=True)
    members = attention.Members(v, key >> 32, key & 0xFFFFFFFF, number, 10)
    return v, attention.Attention.fresh(v, np.zeros(v.n_classes), 1), members


def test_probabilities_add_up_to_one():
    v, _, members = small_model()
    every = np.arange(41)
    for before in range(42):
        p = 10 ** members.log10(v, np.full(41, before), every)
        assert np.bincount(v.classes, p) == pytest.approx(1)


def test_classes_follow_what_windows_are_about():
    rng = np.random.default_rng(2)
    topic = rng.integers(0, 2, 500)
    rows = topic[:, None] * 200 + np.minimum(rng.geometric(0.02, (500, attention.SPAN)) - 1, 199)
    counts = np.bincount(rows.ravel(), minlength=401).astype(float)  # ids 0-199 and 200-399, then the end
    vectors = attention.id_vectors(rows, counts)
    assert vectors[400].tolist() == [0] * vectors.shape[1]
    v = attention.vocabulary(counts, np.ones(401, bool), vectors)
    assert v.classes.min() == 0 and len(np.unique(v.classes)) == v.n_classes
    np.testing.assert_allclose(np.bincount(v.classes, v.share), 1)
    seen = np.flatnonzero((counts > 0) & (v.classes > attention.SINGLES))
    for c in np.unique(v.classes[seen]):
        sides = seen[v.classes[seen] == c] >= 200
        assert sides.all() or not sides.any()


def test_windows_score_every_id_once_whatever_the_batch():
    v, model, members = small_model()
    ends = np.zeros(44, bool)
    texts = [np.arange(n) % 40 for n in (0, 1, 15, 16, 17, 300)]
    together = language_model.score_ids(texts, v, model, members, ends)
    alone = [language_model.score_ids([t], v, model, members, ends)[0] for t in texts]
    assert together == pytest.approx(alone)
    given, targets = attention.windows(texts[-1], v)
    assert targets[targets >= 0].tolist() == [*texts[-1], v.end] and given.shape[1] == attention.SPAN


def test_gradients_by_differences():
    v, model, _ = small_model()
    rng = np.random.default_rng(0)
    model.weights = {k: x.astype(np.float64) for k, x in model.weights.items()}
    given, targets = attention.windows(rng.integers(0, 40, 40), v)
    rows, wanted, pad = v.inputs[given], np.where(targets >= 0, v.classes[targets], -1), int(v.inputs[v.pad])
    _, g = model.gradients(rows, wanted, pad)
    for name, x in model.weights.items():
        at = tuple(rng.integers(0, n) for n in x.shape)
        old = x[at]
        x[at] = old + 1e-5
        up = model.gradients(rows, wanted, pad)[0]
        x[at] = old - 1e-5
        down = model.gradients(rows, wanted, pad)[0]
        x[at] = old
        assert g[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-6), name


def test_windows_of_all_texts_teach(spark):
    rng = np.random.default_rng(5)
    texts = [np.minimum(rng.geometric(0.02 + 0.01 * i, 1400) - 1, 39) for i in range(20)] + [np.arange(30)]
    counts = np.append(np.bincount(np.concatenate(texts), minlength=40), len(texts)).astype(float)
    v = attention.vocabulary(counts, np.arange(41) < 20)
    parts = [attention.windows(x, v) for x in texts]
    given, wanted = (np.concatenate(x).astype(np.int32) for x in zip(*parts))
    rows = [(i, g.tobytes(), w.tobytes()) for i, (g, w) in enumerate(zip(given, wanted))]
    drawn = spark.createDataFrame(rows, "draw long, given binary, wanted binary").repartition(4)
    sums = language_model._vectors(drawn, len(rows), counts)
    alone = attention.id_vectors(given.astype(np.int64), counts)
    np.testing.assert_allclose(sums @ sums.T, alone @ alone.T, atol=1e-3)
    model = attention.Attention.fresh(v, np.zeros(v.n_classes), 1)
    classes = np.where(wanted >= 0, v.classes[np.maximum(wanted, 0)], -1)
    before = model.log10_classes(v.inputs[given], classes, int(v.inputs[v.pad])).sum()
    language_model._learn(drawn, v, model, 3)
    assert model.log10_classes(v.inputs[given], classes, int(v.inputs[v.pad])).sum() > 0.99 * before
    # a long text gives its share of windows, a short one gives one
    path = language_model.TOKENIZER
    size = Tokenizer.from_file(path).get_vocab_size()
    v = attention.vocabulary(np.ones(size + 1), np.ones(size + 1, bool))
    batch = pa.record_batch([pa.array([1, 2, 3]), pa.array(["one two " * 2000, "one", None])], names=["draw", "text"])
    got = Counter(r["draw"] for b in language_model._sample(path, v, 5)(iter([batch])) for r in b.to_pylist())
    assert got[1] > 4 and got[2] == got[3] == 1


def test_every_window_of_a_training_text_is_learnt_from():
    path = language_model.TOKENIZER
    size = Tokenizer.from_file(path).get_vocab_size()
    v = attention.vocabulary(np.ones(size + 1), np.ones(size + 1, bool))
    text = "one two three " * 300
    batch = pa.record_batch([pa.array([7]), pa.array([text])], names=["draw", "text"])
    rows = [r for b in language_model._sample(path, v, 5)(iter([batch])) for r in b.to_pylist()]
    _, (ids,) = language_model._encoded(path, [text])
    given, targets = attention.windows(ids, v)
    want = Counter((g.astype(np.int32).tobytes(), t.astype(np.int32).tobytes()) for g, t in zip(given, targets))
    assert Counter((r["given"], r["wanted"]) for r in rows) == want


# 10 join


def brute_components(rows):
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if x == a else x for x in group]
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), (min(ids) if ids else None) if sets[i] else r[0]))
    return out


def test_join_equals_brute_force(docs, nothing, monkeypatch):
    got = [tuple(r) for r in ngram_join.join_by_shingles(docs).collect()]
    assert sorted(got, key=repr) == sorted(brute_components(ROWS), key=repr)
    assert ngram_join.join_by_shingles(nothing).count() == 0


def test_join_in_small_blocks(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "QUERIES", 2)
    got = [tuple(r) for r in ngram_join.join_by_shingles(docs).collect()]
    assert sorted(got, key=repr) == sorted(brute_components(ROWS), key=repr)


def test_divide_skip_equals_counting():
    rng = np.random.default_rng(5)
    base = rng.choice(5000, 120, replace=False).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(120) < 0.93], rng.choice(5000, 12).astype(np.uint64)])) for _ in range(60)]
    index = ngram_join.Index(sets)
    for s in sets:
        want = [i for i, x in enumerate(sets) if 100 * len(np.intersect1d(s, x)) >= 75 * len(np.union1d(s, x))]
        assert index.search(s, 75).tolist() == want


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90)], "a long, b long")
    got = {(r.node, r.label) for r in linking.components(links).collect()}
    assert got == {(i, 0) for i in range(41)} | {(100, 90), (90, 90)}


def test_filter_loses_nothing(spark):
    rows, keys = spark.range(1000).withColumnRenamed("id", "k"), spark.range(0, 1000, 7)
    got = {r.k for r in linking.probably_in(rows, "k", keys, bits=12).collect()}
    assert got >= set(range(0, 1000, 7)) and len(got) < 1000
