"""Soft-membership mixing: document rates whose expected domain token totals match target weights."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from steepgrid.llm.linking import probably_in
from steepgrid.llm.text_stats import SYMBOLS, word_characters
from steepgrid.llm.words import lower_words, settle, unused
from steepgrid.session import materialise

DOMAINS = ["clean", "low", "toxic"]
TARGETS = {"clean": 0.985, "low": 0.005, "toxic": 0.01}
BUCKETS = 1 << 16
SHAPES = 64  # of the buckets, the last ones describe the text's characters
PREFIXES = 1 << 17  # more buckets, for the first bytes of longer words
WIDTHS = (5, 6, 7, 8)  # as many of them
MARKS = BUCKETS + PREFIXES
PRESENT, ABSENT = 1 / 3, 0.05  # weight of a prefix that is there or not: prefixes of one word say much the same
FACTOR = 2.0  # a telling mark is this many times as frequent in a domain's documents as in all
CERTAIN = 5.0  # and this many standard errors over what is expected
LEAST = 5  # and in this many of them
LANGUAGES = 16  # counted together by one task
ROUNDS = 30
CLOSE = 1e-6  # stop when totals miss their targets by this share of all tokens
HOLD = 0.1  # a rate this close to one is one copy


def domain_of(labels: DataFrame) -> Column:
    """A labelled row's domain: toxic if marked so, else low or clean by its quality; null without either."""
    return F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)


_EDGE = np.isin(np.arange(256), list(b".,;:!?"))  # not part of a word at its ends
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x)
    for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)
_TAIL = 32  # bytes from which on a word is hashed alone
_TOGETHER = 1 << 20  # bytes of distinct words hashed in one step


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def short_hashes(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of stretches of fewer than 32 bytes, many in one step; ``raw`` has 32 more bytes behind the last."""
    found = np.uint64(seed) + _P5 + sizes.astype(np.uint64)
    order = np.argsort(-sizes, kind="stable")  # the longest first, so that a step takes the first some
    found, starts, sizes = found[order], starts[order], sizes[order]
    wide = np.lib.stride_tricks.sliding_window_view(raw, 8)
    at = starts.copy()
    for lane in range(int(sizes[0]) // 8 if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -8 * (lane + 1), "right"))
        lanes = wide[at[:n]].view("<u8").ravel()
        found[:n] = _turned(found[:n] ^ (_turned(lanes * _P2, 31) * _P1), 27) * _P1 + _P4
        at[:n] += 8
    some = np.flatnonzero(sizes & 4)
    half = np.ascontiguousarray(wide[at[some], :4]).view("<u4").ravel().astype(np.uint64)
    found[some] = _turned(found[some] ^ (half * _P1), 23) * _P2 + _P3
    at[some] += 4
    for rest in range(1, 4):
        some = np.flatnonzero((sizes & 3) >= rest)
        found[some] = _turned(found[some] ^ (raw[at[some]].astype(np.uint64) * _P5), 11) * _P1
        at[some] += 1
    found = (found ^ (found >> np.uint64(33))) * _P2
    found = (found ^ (found >> np.uint64(29))) * _P3
    out = np.empty_like(found)
    out[order] = found ^ (found >> np.uint64(32))
    return out


def _word_buckets(texts: list[list[bytes]]) -> list[np.ndarray]:
    """Buckets of the words of each text and of their prefixes, some more than once."""
    counts = np.array([len(words) for words in texts], np.int64)
    every = [word for words in texts for word in words]
    raw = np.frombuffer(b" ".join([*every, bytes(_TAIL)]), np.uint8)
    lengths = np.fromiter(map(len, every), np.int64, len(every))
    ends = np.cumsum(lengths + 1) - 1
    inner = np.flatnonzero(~_EDGE[raw])  # the zeros at the end are inner ones
    first = inner[np.searchsorted(inner, ends - lengths)]
    last = inner[np.maximum(np.searchsorted(inner, ends) - 1, 0)]
    # the blank behind a word of nothing but marks is found first
    empty = first >= ends
    starts = np.where(empty, ends, first)
    sizes = np.where(empty, 0, last + 1 - first)
    owner = np.repeat(np.arange(len(texts)), counts)
    whole = np.zeros(len(every), np.uint64)
    short = np.flatnonzero(sizes < _TAIL)
    whole[short] = short_hashes(raw, starts[short], sizes[short])
    for i in np.flatnonzero(sizes >= _TAIL):
        whole[i] = xxhash.xxh64_intdigest(raw[starts[i] : starts[i] + sizes[i]].tobytes())
    found, owners = [whole % np.uint64(BUCKETS - SHAPES)], [owner]
    for n in WIDTHS:
        some = np.flatnonzero(sizes > n)
        hashes = short_hashes(raw, starts[some], np.full(len(some), n), n)
        found.append(hashes % np.uint64(PREFIXES) + np.uint64(BUCKETS))
        owners.append(owner[some])
    owner = np.concatenate(owners)
    order = np.argsort(owner.astype(np.uint16) if len(texts) < 1 << 16 else owner, kind="stable")
    buckets = np.concatenate(found).astype(np.int64)[order]
    return np.split(buckets, np.searchsorted(owner[order], np.arange(1, len(texts))))


def _shape(text: str, words: int, distinct: int) -> list[int]:
    chars = max(1, word_characters(text))
    raw = text.encode("utf-8", "surrogatepass")
    upper = len(raw) - len(raw.translate(None, bytes(range(65, 91))))
    shares = (
        sum(map(text.count, SYMBOLS)) / words,
        upper / chars,
        text.count("!") / words,
        min(1.0, distinct / words),
    )
    return [BUCKETS - SHAPES + 16 * i + min(15, int(share * 10)) for i, share in enumerate(shares)]


def marked(texts: Iterable[str | None]) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """Of every text the number of words, the buckets of its words and of their prefixes, some more than once, and those
    of its shape; the words of many texts are hashed together."""
    held: list[tuple] = []
    size = 0

    def done():
        for (n, _, shape), found in zip(held, _word_buckets([words for _, words, _ in held]) if held else [], strict=True):
            yield n, found, shape

    for text in texts:
        words = lower_words(text)
        distinct = list(set(words))
        held.append((len(words), distinct, _shape(text, len(words), len(distinct)) if words else []))
        size += sum(map(len, distinct)) + 1
        if size >= _TOGETHER:
            yield from done()
            held, size = [], 0
    yield from done()


def marks(text: str | None) -> tuple[int, np.ndarray]:
    """Number of words, and the buckets of a text's distinct words, of their prefixes and of its shape."""
    ((n, found, shape),) = marked([text])
    return n, np.array([*np.unique(found), *shape], np.int64)


def _count_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each domain by language and bucket; the extra bucket counts all."""
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), *((d, pa.int64()) for d in DOMAINS)])
    held: dict[str | None, np.ndarray] = {}

    def counted():
        for lang, counts in held.items():
            bucket = np.flatnonzero(counts.any(axis=0))
            columns = [pa.array([lang] * len(bucket), pa.string()), pa.array(bucket, pa.int32())]
            columns += [pa.array(row[bucket]) for row in counts]
            yield pa.record_batch(columns, schema=schema)
        held.clear()

    for batch in batches:
        langs, domains = batch.column("lang").to_pylist(), batch.column("domain").to_pylist()
        for lang, domain, (_, found, shape) in zip(langs, domains, marked(batch.column("text").to_pylist()), strict=True):
            if lang not in held:
                if len(held) >= LANGUAGES:
                    yield from counted()
                held[lang] = np.zeros((len(DOMAINS), MARKS + 1), np.int64)
            row = held[lang][domain]
            row[found] += 1  # a repeated bucket counts once
            row[[*shape, MARKS]] += 1
    yield from counted()
    settle()


@dataclass
class Evidence:
    """Log weight of each domain for a text without any telling mark, and what each telling mark adds."""

    prior: np.ndarray
    telling: np.ndarray  # sorted buckets
    ratio: np.ndarray  # domain, place in ``telling``

    def __post_init__(self):
        self.tells = np.zeros(MARKS, bool)
        self.tells[self.telling] = True

    def logs(self, found: np.ndarray, shape: list[int]) -> np.ndarray:
        """Of a text with these buckets, which may be repeated, and those of its shape."""
        if not len(self.telling):
            return self.prior
        found = np.array([*np.unique(found[self.tells[found]]), *shape], np.int64)
        at = np.minimum(np.searchsorted(self.telling, found), len(self.telling) - 1)
        return self.prior + self.ratio[:, at[self.telling[at] == found]].sum(axis=1)


def evidence(counts: np.ndarray, pooled: np.ndarray) -> Evidence:
    """What the marks of one language tell. Both tables have the last column for all documents of a domain.

    A mark tells domains apart if some domain's documents hold it far more often than all documents do: by a factor,
    by many standard errors, and in a few documents. Presence and absence of these marks count (Bernoulli naive
    Bayes), those of prefixes less; all others say nothing. The shape of a text is no matter of language, so its
    marks are judged by ``pooled`` counts.
    """
    shape = np.zeros(MARKS, bool)
    shape[BUCKETS - SHAPES : BUCKETS] = True
    prefix = np.arange(MARKS) >= BUCKETS

    def judged(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        docs, seen = table[:, -1:].astype(float), table[:, :-1].astype(float)
        overall = (seen.sum(axis=0) + 0.5) / (docs.sum() + 1)
        share = (seen + 0.5) / (docs + 1)
        expected = overall * docs
        often = (share > FACTOR * overall) & (seen - expected > CERTAIN * np.sqrt(expected + 1)) & (seen >= LEAST)
        return often.any(axis=0), share

    (telling, share), (shape_tells, shape_share) = judged(counts), judged(pooled)
    telling, share = np.where(shape, shape_tells, telling), np.where(shape, shape_share, share)
    some = np.flatnonzero(telling)
    share, prefix = share[:, some], prefix[some]
    here = np.log(share) * np.where(prefix, PRESENT, 1)
    gone = np.log1p(-np.minimum(share, 0.999)) * np.where(prefix, ABSENT, 1)
    docs = counts[:, -1].astype(float)
    prior = np.log((docs + 0.5) / (docs.sum() + 0.5 * len(docs)))
    return Evidence(prior + gone.sum(axis=1), some, here - gone)


def evidences(tables: dict[str | None, np.ndarray]) -> dict[str | None, Evidence]:
    """Evidence by language from counts by language. Under null that of all languages together, which also serves
    texts without a language and languages with too few labelled documents of a domain to tell any mark."""
    pooled = tables.get(None, np.zeros((len(DOMAINS), MARKS + 1), np.int64))
    enough = np.minimum(pooled[:, -1], LEAST)
    own = {g: t for g, t in tables.items() if g is not None and (t[:, -1] >= enough).all()}
    return {None: evidence(pooled, pooled)} | {g: evidence(t, pooled) for g, t in own.items()}


@dataclass
class Mixer:
    """Posteriors of a text's domains, and its rate after the steps taken so far."""

    languages: dict[str | None, Evidence]
    steps: list[np.ndarray] = field(default_factory=list)

    def posteriors(self, langs: list[str | None], found: list[tuple[np.ndarray, list[int]]]) -> np.ndarray:
        every = self.languages[None]
        logs = [self.languages.get(g, every).logs(*f) for g, f in zip(langs, found, strict=True)]
        logs = np.array(logs).reshape(-1, len(DOMAINS))
        odds = np.exp(np.clip(logs - logs.max(axis=1, keepdims=True), -30, 0))
        return odds / odds.sum(axis=1, keepdims=True)

    def rates(self, p: np.ndarray) -> np.ndarray:
        """Projected gradient: every step moves all rates along their posteriors and cuts them at zero."""
        rate = np.ones(len(p))
        for step in self.steps:
            rate = np.maximum(0.0, rate - p @ step)
        return rate


_POSTERIORS = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("p", pa.list_(pa.float64()))])


def _posteriors(mixer: Mixer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                some = list(marked(batch.column("text").to_pylist()))
                sizes, found = [n for n, *_ in some], [f for _, *f in some]
                p = mixer.posteriors(batch.column("lang").to_pylist(), found)
                columns = [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(p.tolist(), pa.list_(pa.float64()))]
                yield pa.record_batch(columns, schema=_POSTERIORS)
        settle()

    return run


def _p(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("p").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _totals(mixer: Mixer):
    """Per partition: tokens, expected tokens of each domain, and the curvature over rows with a positive rate."""
    schema = pa.schema([("sums", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(DOMAINS)
        sums = np.zeros(1 + k + k * k)
        for batch in batches:
            if batch.num_rows:
                p, n = _p(batch), batch.column("n_tokens").to_numpy(zero_copy_only=False).astype(float)
                rate = mixer.rates(p)
                active = p * (n * (rate > 0))[:, None]
                sums += np.concatenate([[n.sum()], (n * rate) @ p, (active.T @ p).ravel()])
        yield pa.record_batch([pa.array([sums.tolist()], pa.list_(pa.float64()))], schema=schema)

    return run


def _rates(mixer: Mixer):
    schema = pa.schema(list(_POSTERIORS) + [pa.field("rate", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch([*batch.columns, pa.array(mixer.rates(_p(batch)))], schema=schema)

    return run


def _lang(docs: DataFrame, lang_col: str) -> Column:
    """A row's language; null in tables without that column."""
    return F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")


def fit_mixer(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float],
    id_col: str,
    text_col: str,
    lang_col: str,
) -> tuple[Mixer, DataFrame]:
    """The fitted mixer and every row's id, word count and posteriors."""
    texts = docs.select(
        F.col(id_col).cast("long").alias("id"), _lang(docs, lang_col).alias("lang"), F.col(text_col).cast("string").alias("text")
    )
    taught = materialise(
        labels.where(F.col(id_col).isNotNull())
        .withColumn("_domain", domain_of(labels))
        .where("_domain is not null")
        .groupBy(F.col(id_col).cast("long").alias("label_id"))
        .agg(F.max("_domain").cast("int").alias("domain")),
        "mix-labels",
    )
    # texts are shuffled to their labels, as they are smaller than their marks; at every size alike
    by_lang = materialise(
        probably_in(texts, "id", taught.select("label_id"))
        .join(taught.hint("merge"), F.col("id") == F.col("label_id"))
        .select("lang", "domain", "text")
        .mapInArrow(_count_marks, "lang string, bucket int, " + ", ".join(f"{d} long" for d in DOMAINS))
        .groupBy("lang", "bucket")
        .agg(*[F.sum(d).alias(d) for d in DOMAINS]),
        "mix-counts",  # at most languages times buckets rows
    )
    pooled = by_lang.groupBy("bucket").agg(*[F.sum(d).alias(d) for d in DOMAINS])
    counted = (
        by_lang.where("lang is not null")
        .unionByName(pooled.select(F.lit(None).cast("string").alias("lang"), "bucket", *DOMAINS))
        # no mark in fewer documents of each domain tells anything
        .where((F.greatest(*DOMAINS) >= LEAST) | F.col("bucket").between(BUCKETS - SHAPES, BUCKETS - 1) | (F.col("bucket") == MARKS))
        .toArrow()
    )
    tables: dict[str | None, np.ndarray] = {}
    for lang in counted["lang"].unique().to_pylist():
        held = counted["lang"].is_null() if lang is None else pc.equal(counted["lang"], lang)
        some = counted.filter(held)
        table = tables[lang] = np.zeros((len(DOMAINS), MARKS + 1), np.int64)
        table[:, some["bucket"].to_numpy()] = [some[d].to_numpy() for d in DOMAINS]
    mixer = Mixer(evidences(tables))
    rows = materialise(texts.mapInArrow(_posteriors(mixer), "id long, n_tokens long, p array<double>"), "mix-posteriors")

    k = len(DOMAINS)
    weights = np.array([targets[d] for d in DOMAINS], float)
    weights /= weights.sum()
    goal = None
    for _ in range(ROUNDS):
        parts = rows.mapInArrow(_totals(mixer), "sums array<double>")
        row = parts.agg(*[F.sum(F.col("sums")[i]).alias(str(i)) for i in range(1 + k + k * k)]).first()
        sums = np.array([x or 0.0 for x in row])
        tokens, expected = max(1.0, sums[0]), sums[1 : 1 + k]
        if goal is None:  # the domain with the greatest weight keeps its tokens
            main = int(np.argmax(weights))
            goal = weights * expected[main] / weights[main]
        residual = (expected - goal) / tokens
        if np.abs(residual).max() <= CLOSE:
            break
        curvature = sums[1 + k :].reshape(k, k) / tokens
        mixer.steps.append(np.linalg.solve(curvature + 1e-9 * np.eye(k), residual))
    return mixer, rows


def copies(rate: Column, key: Column) -> Column:
    """Whole copies of a document: the rate rounded up with the probability of its fraction, by a digest of the key."""
    draw = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = F.floor(rate + draw)
    return F.when(F.abs(rate - 1) <= HOLD, 1).otherwise(drawn).cast("int")


def mix_rates(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """Rates at which documents are taken so that the expected tokens of the domains match ``targets``.

    Domains are the classes of the labelled table. A classifier counts labelled documents by language, domain and
    hashed word or prefix (all of them, in a table of fixed size per language) and gives every document posteriors
    (``evidence``). Rates start at one and move by projected
    gradient steps on the squared distance of expected totals from the targets, scaled by the curvature over rows not
    at zero; a step needs only sums of a fixed size, and a rate follows from the posteriors and the steps taken.
    The domain with the greatest target keeps its tokens. A token is a word.

    Returns ``id_col, n_tokens``, a posterior ``p_<domain>`` per domain, ``rate`` and ``copies``. Null and empty texts have
    no tokens and the prior as posterior; repeated rows get equal rates; ids labelled more than once belong to
    the last of clean, low, toxic; null labels and ids do not teach; without labels all domains are equally likely;
    an empty table gives an empty result; other columns are ignored.
    """
    mixer, rows = fit_mixer(docs, labels, targets or TARGETS, id_col, text_col, lang_col)
    rated = rows.mapInArrow(_rates(mixer), "id long, n_tokens long, p array<double>, rate double")
    return rated.select(
        F.col("id").alias(id_col),
        "n_tokens",
        *[F.col("p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)],
        "rate",
        copies(F.col("rate"), F.col("id")).alias("copies"),
    )


def mix_documents(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """The documents themselves, each as often as its rate gives; all columns stay. See ``mix_rates``."""
    mixer, _ = fit_mixer(docs, labels, targets or TARGETS, id_col, text_col, lang_col)

    @F.pandas_udf("double")
    def rate(langs: pd.Series, texts: pd.Series) -> pd.Series:
        found = [f for _, *f in marked(texts)]
        langs = [g if isinstance(g, str) else None for g in langs]
        return pd.Series(mixer.rates(mixer.posteriors(langs, found)) if len(found) else [], dtype="float64")

    times = copies(rate(_lang(docs, lang_col), F.col(text_col).cast("string")), F.col(id_col).cast("long"))
    many, one = unused(docs.columns, "_copies", "_copy")
    return (
        docs.withColumn(many, times)
        .where(F.col(many) > 0)
        .withColumn(one, F.explode(F.sequence(F.lit(1), F.col(many))))
        .select(*docs.columns)
    )
