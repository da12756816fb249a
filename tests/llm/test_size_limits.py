"""What steps write and hold for a unit of input, and that the compact forms lose nothing."""

import numpy as np
import pyarrow as pa
import xxhash
from tokenizers import Tokenizer

from steepgrid.llm import attention, language_model, mixing, ngram_join, packing


def test_packed_gaps_keep_every_key():
    rng = np.random.default_rng(1)
    longest = (1 << 24) - 1
    edges = [7, 7, 8, 7 + longest, 7 + 2 * longest, 8 + 4 * longest, 8 + 4 * longest]
    for keys in ([], [7], edges, rng.integers(7, 1 << 40, 5000)):
        keys = np.sort(np.array(keys, np.uint64))
        assert ngram_join.unpacked_gaps(ngram_join.packed_gaps(keys, 7), 7).tolist() == keys.tolist()


def test_repeated_shingles_are_exchanged_in_three_bytes_and_all_found(monkeypatch):
    monkeypatch.setattr(ngram_join, "COUNTED", 200_000)
    rng = np.random.default_rng(2)
    texts = [" ".join(map(str, rng.integers(0, 1 << 40, 5000))) for _ in range(100)]
    texts += [f"{text} tail" for text in texts[::7]]
    sets = list(ngram_join.shingle_sets(texts))
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    parts = list(ngram_join._keys(5)(iter([batch])))
    total = sum(len(s) for s in sets)
    assert sum(len(x) for p in parts for x in p.column("keys").to_pylist()) < 3.2 * total
    rows = sorted((r, i, k) for i, p in enumerate(parts) for r, k in zip(*(c.to_pylist() for c in p.columns), strict=True))
    table = pa.table({"range": pa.array([r for r, _, _ in rows], pa.int32()), "keys": [k for _, _, k in rows]})
    bits = np.zeros(1 << ngram_join.MAP_BITS, bool)
    for found in ngram_join._repeated(iter(table.to_batches())):
        for number, some in zip(*(c.to_pylist() for c in found.columns), strict=True):
            some = np.unpackbits(np.frombuffer(some, np.uint8)).astype(bool)
            bits[number * len(some) : (number + 1) * len(some)] = some
    keys, times = np.unique(np.concatenate(sets) >> np.uint64(24), return_counts=True)
    want = np.zeros(1 << ngram_join.MAP_BITS, bool)
    want[ngram_join._place(keys[times > 1])] = True
    assert (bits == want).all()


def old_marks(text):
    """Buckets word by word, with the library's hash."""
    buckets = set()
    for word in (text or "").encode().lower().split():
        bare = word.strip(b".,;:!?")
        buckets.add(xxhash.xxh64_intdigest(bare) % (mixing.BUCKETS - mixing.SHAPES))
        for n in mixing.WIDTHS:
            if len(bare) > n:
                buckets.add(mixing.BUCKETS + xxhash.xxh64_intdigest(bare[:n], n) % mixing.PREFIXES)
    return sorted(buckets)


def test_words_of_many_texts_are_marked_together(monkeypatch):
    rng = np.random.default_rng(3)
    alphabet = list("abcdefgé.,!?xyzÄ")
    texts = [" ".join("".join(rng.choice(alphabet, rng.integers(1, 40))) for _ in range(60)) for _ in range(40)]
    texts += [None, "", " \t\n", "!", "... a !?", "x" * 31, "x" * 32 + "!", "Y" * 500, "a\x00 \x00", "!" * 90 + " b"]
    want = [old_marks(t) for t in texts]
    calls = []
    real = xxhash.xxh64_intdigest
    monkeypatch.setattr(mixing.xxhash, "xxh64_intdigest", lambda *x: calls.append(x) or real(*x))
    found = list(mixing.marked(texts))
    assert [np.unique(f).tolist() for _, f, _ in found] == want
    assert [n for n, *_ in found] == [len((t or "").encode().split()) for t in texts]
    assert all(len(x[0]) >= 32 for x in calls)  # word by word only long ones
    assert [mixing.marks(t)[1].tolist() for t in texts] == [[*w, *shape] for w, (_, _, shape) in zip(want, found)]


def test_windows_are_exchanged_as_ids_once(spark):
    path = language_model.TOKENIZER
    size = Tokenizer.from_file(path).get_vocab_size()
    v = attention.vocabulary(np.ones(size + 1), np.ones(size + 1, bool))
    for n in (0, 1, 14, 15, 16, 17, 1022, 1023, 1024, 1025, 5000):
        text = "one " * n
        batch = pa.record_batch([pa.array([7]), pa.array([text])], names=["draw", "text"])
        rows = [r for b in language_model._runs(path, v)(iter([batch])) for r in b.to_pylist()]
        _, (ids,) = language_model._encoded(path, [text])
        assert sum(len(r["ids"]) for r in rows) <= 2 * (len(ids) + 1) + 18 * len(rows)
        assert [r["run"] for r in rows] == list(range(len(rows))) and len(rows) <= len(ids) // 1024 + 1
        parts = list(language_model._stretches(language_model._runs(path, v)(iter([batch])), v))
        for got, want in zip((np.concatenate(x) for x in zip(*parts)), attention.windows(ids, v)):
            assert got.tolist() == want.tolist()


def test_plain_units_go_to_the_model_alone(monkeypatch):
    cache = packing.ChunkIds(packing.TOKENIZER)
    whole, calls = cache.tokenizer, []

    class Counting:
        def __getattr__(self, name):
            return getattr(whole, name)

        def encode(self, text, **more):
            calls.append(text)
            return whole.encode(text, **more)

    monkeypatch.setattr(cache, "tokenizer", Counting())
    letters = [chr(i) for i in range(256)]
    texts = [" ".join(f"{a}{x}{y}{b}" for y in letters) for x in letters for a, b in (("Q", "s"), ("'", "ll"), ("", "'"))]
    for text, ids in zip(texts, packing.encode_texts(cache, texts, None), strict=True):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids
    # not even a text of Latin-1 in which two signs are a special token's start
    assert all("<|" in text for text in calls)
    calls.clear()
    got = packing.encode_texts(cache, ["plain WORDS, and 日本 it's", None], 2)
    assert calls == ["日本"] and got[1].tolist() == [2]


def test_neighbours_keep_their_order_however_many_there_are():
    rng = np.random.default_rng(4)
    for n in (0, 1, 200, 256, 257, 3000):
        score = rng.integers(0, 40, n).astype(float)
        some = np.flatnonzero(score)
        assert list(packing._falling(score)) == some[np.argsort(-score[some], kind="stable")].tolist()


def test_an_index_thinned_out_packs_like_the_whole(monkeypatch):
    rng = np.random.default_rng(6)
    docs = [(rng.zipf(1.2, n) % 300).astype(np.uint16) for n in rng.integers(1, 300, 600)]
    idf = rng.random(300).astype(np.float32)
    got = list(packing.pack_shard(docs, idf, 150.0, 512))
    monkeypatch.setattr(packing, "LIVE", 0.0)
    assert got == list(packing.pack_shard(docs, idf, 150.0, 512))
