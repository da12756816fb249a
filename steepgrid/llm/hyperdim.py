"""Language of a text by hyperdimensional profiles: letters are random vectors, n-grams bind them, texts bundle n-grams."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from steepgrid.llm.words import mixed
from steepgrid.operators.ranks import number_rows
from steepgrid.session import materialise

WIDTH = 1024  # components of a vector
GRAM = 3  # letters of an n-gram
DOCUMENT_WEIGHT = 1 << 24  # what a document's n-grams weigh together in its language's profile
JOINT_LETTERS = 1_000_000  # letters of short texts handled in one step, and the length of a long text's pieces
JOINT_TEXTS = 512  # texts, and different n-grams of theirs, that are multiplied in one step
JOINT_GRAMS = 4096
HELD_LANGUAGES = 256  # profiles a training task holds before it hands them on
PROFILES = 1024  # profiles compared in one pass, 8 KB each; more languages take more passes
TABLE_SIZE = 1 << 22  # n-gram codes counted in a plain table; beyond it they are sorted
UNKNOWN = "und"

_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_letters: list[np.ndarray] = []


def is_letter(codes: np.ndarray) -> np.ndarray:
    """Whether code points are letters of any script; the table is built once in a worker (1.1 MB)."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0][codes]


def letters_of(text: str | None) -> np.ndarray:
    """Lower-cased code points with every stretch of other characters as one 0, and a 0 at both ends; empty without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(is_letter(codes), codes, np.uint32(0))
    if not codes.any():
        return np.empty(0, np.uint32)
    codes = np.concatenate([np.zeros(1, np.uint32), codes, np.zeros(1, np.uint32)])
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    return codes[keep]


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    """A random vector of signs per code point, as bits: the same one everywhere."""
    with np.errstate(over="ignore"):
        seeds = mixed(codes.astype(np.uint64) * _SPREAD + np.uint64(1))
        parts = mixed(seeds[:, None] + np.arange(1, WIDTH // 64 + 1, dtype=np.uint64)[None, :] * _SPREAD)
    return parts.astype("<u8").view(np.uint8).reshape(len(codes), WIDTH // 8)


def gram_vectors(codes: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Vectors of +1 and -1 of n-grams, given as places in ``codes``.

    The letter at position i of an n-gram is permuted by i cyclic shifts of eight components; binding multiplies signs,
    which on bits is exclusive or.
    """
    vectors = letter_vectors(codes)
    bound = np.zeros((len(grams), WIDTH // 8), np.uint8)
    for i in range(GRAM):
        bound ^= np.roll(vectors, i, axis=1)[grams[:, i]]
    return 1 - 2 * np.unpackbits(bound, axis=1).astype(np.float32)


def counted(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """N-grams of some texts with at least one letter each: (text, number) of every one, then by number the places of
    its letters in the last array, the code points."""
    codes, joint = np.unique(np.concatenate(texts), return_inverse=True)
    ends = np.cumsum([len(t) for t in texts])
    base = len(codes)
    grams = np.zeros(len(joint) - GRAM + 1, np.int64)
    for i in range(GRAM):
        grams = grams * base + joint[i : len(grams) + i]
    text_of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])[: len(grams)]
    inside = np.ones(len(grams), bool)  # n-grams that reach over a text's end do not count
    for i in range(1, GRAM):
        places = ends[:-1] - i
        inside[places[places < len(grams)]] = False
    grams, text_of = grams[inside], text_of[inside]
    if base**GRAM <= TABLE_SIZE:
        kinds = np.flatnonzero(np.bincount(grams, minlength=base**GRAM))
        number = np.zeros(base**GRAM, np.int64)
        number[kinds] = np.arange(len(kinds))
        grams = number[grams]
    else:
        kinds, grams = np.unique(grams, return_inverse=True)
    return text_of, grams, np.stack([kinds // base ** (GRAM - 1 - i) % base for i in range(GRAM)], axis=1), codes


def summed(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the n-gram vectors, number of n-grams) of some texts, ``JOINT_GRAMS`` different n-grams at a time.

    Counts stay under 2 ** 24, so sums of 32-bit floats are exact.
    """
    text_of, grams, places, codes = counted(texts)
    sums = np.zeros((len(texts), WIDTH), np.float32)
    for first in range(0, len(places), JOINT_GRAMS):
        part = places[first : first + JOINT_GRAMS]
        here = (grams >= first) & (grams < first + JOINT_GRAMS)
        cells = text_of[here] * len(part) + grams[here] - first
        counts = np.bincount(cells, minlength=len(texts) * len(part)).reshape(len(texts), len(part))
        sums += counts.astype(np.float32) @ gram_vectors(codes, part)
    return sums, np.bincount(text_of, minlength=len(texts))


def bundles(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the n-gram vectors, number of n-grams) of every text; a long one is summed piece by piece."""
    sums = np.zeros((len(texts), WIDTH))
    totals = np.zeros(len(texts), np.int64)
    pieces = [
        (i, text[at : at + JOINT_LETTERS + GRAM - 1])
        for i, text in enumerate(texts)
        for at in range(0, max(1, len(text) - GRAM + 1), JOINT_LETTERS)
    ]
    held, size = [], 0
    for k, (i, piece) in enumerate(pieces):
        held.append((i, piece))
        size += len(piece)
        if k + 1 == len(pieces) or len(held) >= JOINT_TEXTS or size + len(pieces[k + 1][1]) > JOINT_LETTERS:
            vectors, numbers = summed([p for _, p in held])
            owners = [i for i, _ in held]
            np.add.at(sums, owners, vectors)
            np.add.at(totals, owners, numbers)
            held, size = [], 0
    return sums, totals


def _steps(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[list[tuple], list[np.ndarray]]]:
    """Rows and letters of some texts at a time."""
    rows, letters, size = [], [], 0
    for batch in batches:
        for *row, text in zip(*(batch.column(c).to_pylist() for c in (*columns, "text")), strict=True):
            found = letters_of(text)
            if rows and (size + len(found) > JOINT_LETTERS or len(rows) >= JOINT_TEXTS):
                yield rows, letters
                rows, letters, size = [], [], 0
            rows.append(tuple(row))
            letters.append(found)
            size += len(found)
    if rows:
        yield rows, letters


def _vectors(letters: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``bundles`` of texts that may have no letters, whose vector is 0."""
    sums, totals = np.zeros((len(letters), WIDTH)), np.zeros(len(letters), np.int64)
    some = [i for i, x in enumerate(letters) if len(x)]
    if some:
        sums[some], totals[some] = bundles([letters[i] for i in some])
    return sums, totals


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of whole numbers per language, so that a profile does not depend on the order of rows."""
    held: dict[str, np.ndarray] = {}

    def handed_on() -> pa.RecordBatch:
        names = pa.array(list(held), pa.string())
        profiles = pa.array([v.tolist() for v in held.values()], pa.list_(pa.int64()))
        held.clear()
        return pa.RecordBatch.from_arrays([names, profiles], ["lang", "profile"])

    for rows, letters in _steps(batches, "lang"):
        sums, totals = _vectors(letters)
        weights = DOCUMENT_WEIGHT // np.maximum(totals, 1)
        weighted = sums.astype(np.int64) * np.maximum(weights, 1)[:, None]
        for (lang,), vector, total in zip(rows, weighted, totals, strict=True):
            if total:
                if lang not in held and len(held) >= HELD_LANGUAGES:
                    yield handed_on()
                held[lang] = held[lang] + vector if lang in held else vector
    if held:
        yield handed_on()


def _judge(names: list[str], profiles: np.ndarray, common: np.ndarray, id_type: pa.DataType):
    """Best language of every text among ``names``, by the cosine of vectors from which what all profiles share is taken."""
    directions = profiles - profiles @ common[:, None] * common[None, :] if len(names) else profiles
    norms = np.linalg.norm(directions, axis=1, keepdims=True)
    directions = np.divide(directions, norms, out=np.zeros_like(directions), where=norms > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, letters in _steps(batches, "id", "held_out"):
            sums, totals = _vectors(letters)
            sums -= (sums @ common)[:, None] * common[None, :]
            lengths = np.linalg.norm(sums, axis=1)
            if names:
                # rounded, as the last digits depend on which texts are multiplied together; equal cosines: the first name
                cosines = np.round(sums @ directions.T / np.maximum(lengths, 1e-12)[:, None], 12)
                best = cosines.argmax(axis=1)
                score = np.clip(cosines[np.arange(len(best)), best], 0.0, 1.0)
            else:
                best, score = np.zeros(len(rows), int), np.zeros(len(rows))
            known = (totals > 0) & bool(names)
            yield pa.record_batch(
                [
                    pa.array([r[0] for r in rows], id_type),
                    pa.array([r[1] for r in rows], pa.bool_()),
                    pa.array([names[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], pa.string()),
                    pa.array(np.where(known, score, 0.0), pa.float64()),
                ],
                names=["id", "held_out", "lang_pred", "score"],
            )

    return run


def held_out(id_col: Column) -> Column:
    """Rows that do not teach; a null id is not held out, but nothing is learnt from it either."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn_profiles(taught: DataFrame) -> DataFrame:
    """Profile of every language of ``taught`` (text, lang): ``lang`` and ``profile``, an array of ``WIDTH`` whole numbers."""
    parts = taught.mapInArrow(_train, "lang string, profile array<bigint>")
    cells = parts.select("lang", F.posexplode("profile").alias("at", "x"))
    cells = cells.groupBy("lang", "at").agg(F.sum("x").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "x")))
    return cells.groupBy("lang").agg(F.transform(ordered, lambda c: c["x"]).alias("profile"))


def predict_language(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Language of every document, learnt from the documents that are not held out.

    A letter of any script is a random vector of ``WIDTH`` signs, drawn from its code point; other characters part words
    and count as one blank. An n-gram binds its ``GRAM`` letters, each permuted by its position, by multiplying them;
    a text bundles its n-grams by adding them; a language's profile adds its documents, each with the same weight.
    Profiles are sums of whole numbers made by Spark. What all profiles have in common, the direction of their mean,
    is taken from profiles and texts (not from a single profile); the profile with the greatest cosine wins, and
    ``score`` is that cosine, 0 if negative. Profiles reach the tasks ``PROFILES`` at a time (8 MB).

    Returns ``id_col, held_out, lang_pred, score``. Null texts and texts without a letter get ``und`` and 0, as do all
    texts when nothing could be learnt; null languages and null ids do not teach; equal cosines go to the first name;
    texts count whole, repeated rows each on their own; an empty table gives an empty result; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(text_col).cast("string").alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
        held_out(F.col(id_col)).alias("held_out"),
    )
    taught = rows.where(F.col("id").isNotNull() & ~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    profiles = materialise(learn_profiles(taught.select("text", "lang")), "language-profiles")
    count = profiles.count()
    common = _common(profiles) if count > 1 else np.zeros(WIDTH)
    schema = StructType().add("id", kind).add("held_out", "boolean").add("lang_pred", "string").add("score", "double")

    def judged(names: list[str], vectors: np.ndarray) -> DataFrame:
        return rows.select("id", "held_out", "text").mapInArrow(_judge(names, vectors, common, to_arrow_type(kind)), schema)

    if count <= PROFILES:
        result = judged(*_fetched(profiles))
    else:
        result = _best_of_passes(rows, profiles, common, kind)
    return result.withColumnRenamed("id", id_col)


def _fetched(profiles: DataFrame) -> tuple[list[str], np.ndarray]:
    """At most ``PROFILES`` profiles as an array, each of length 1."""
    found = profiles.orderBy("lang").collect()
    vectors = np.array([r["profile"] for r in found], np.float64).reshape(len(found), WIDTH)
    return [r["lang"] for r in found], vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def _common(profiles: DataFrame) -> np.ndarray:
    """Direction of the mean of all profiles, each brought to length 1 before."""
    length = F.sqrt(F.aggregate("profile", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    cells = profiles.select(F.posexplode("profile").alias("at", "x"), length.alias("length"))
    sums = cells.where("length > 0").groupBy("at").agg(F.sum(F.col("x") / F.col("length")).alias("x"))
    mean = np.zeros(WIDTH)
    for row in sums.collect():  # WIDTH rows
        mean[row["at"]] = row["x"]
    return mean / max(np.linalg.norm(mean), 1e-12)


def _best_of_passes(rows: DataFrame, profiles: DataFrame, common: np.ndarray, kind) -> DataFrame:
    """The best of several sets of profiles: one pass over the texts for each, joined by the row's number."""
    numbered = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "language-texts")
    ranked = materialise(number_rows(profiles, [], ["lang"], "rank", "n"), "language-ranks")
    schema = StructType().add("id", "long").add("held_out", "boolean").add("lang_pred", "string").add("score", "double")
    passes = []
    for first in range(0, ranked.count(), PROFILES):
        part = ranked.where(F.col("rank").between(first + 1, first + PROFILES))
        passes.append(
            materialise(
                numbered.select(F.col("row").alias("id"), "held_out", "text").mapInArrow(
                    _judge(*_fetched(part), common, pa.int64()), schema
                ),
                "language-pass",
            )
        )
    best = reduce(DataFrame.unionByName, passes).groupBy(F.col("id").alias("row"))
    top = best.agg(F.min(F.struct((-F.col("score")).alias("less"), "lang_pred")).alias("top"))  # equal scores: the first name
    return numbered.join(top, "row").select("id", "held_out", "top.lang_pred", (-F.col("top.less")).alias("score"))
