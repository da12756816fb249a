"""Stretches of words that repeat with a period: multi-scale minimizers seed them, lag scans cover short periods."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from steepgrid.llm.words import mixed, split_words

MIN_LENGTH = 24  # words of the shortest run
MIN_REPEATS = 3  # periods that a run holds at least
LAGS = 16  # periods up to this one are found by scanning the lag itself
JOINT_WORDS = 200_000  # words of short texts that are searched in one step
GROWTH = (3, 2)  # longest over shortest period of a scale
WORD_SPLIT = "[ \\t\\n\\x0B\\f\\r]+"

Run = tuple[int, int, int]  # start, length, period
RUN = "struct<start:bigint,length:bigint,period:bigint>"

_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
RUNS_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def scales(longest: int) -> Iterator[tuple[int, int, int]]:
    """(shortest period, longest period, window) of every scale that covers periods up to ``longest``.

    A scale looks at word n-grams as long as its longest period. Inside a run an n-gram at least as long as the
    period comes again exactly at multiples of the period, and a run of ``MIN_REPEATS`` periods holds two windows
    of this width one period apart, whose minima are the same n-gram.
    """
    low = LAGS + 1
    while low <= longest:
        high = max(low, low * GROWTH[0] // GROWTH[1])
        yield low, high, (MIN_REPEATS - 1) * low - high + 1
        low = high + 1


def _slide(values: np.ndarray, width: int, pick: Callable) -> np.ndarray:
    """``pick`` (minimum or maximum) over every window of ``width`` values."""
    span = 1
    while span * 2 <= width:
        values = pick(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def _minimizers(values: np.ndarray, width: int) -> np.ndarray:
    """Places whose value is the least of some window of ``width`` places."""
    if len(values) < width:
        return np.empty(0, np.int64)
    least = np.zeros(len(values) + width - 1, np.uint64)
    least[width - 1 : len(values)] = _slide(values, width, np.minimum)
    return np.flatnonzero(_slide(least, width, np.maximum) == values)


def _seeds(ids: np.ndarray, longest: Callable[[int], int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per scale: places and lags of consecutive equal minimizers that lie a period of that scale apart.

    ``longest(low)`` says how many leading ids belong to texts that can hold a run of period ``low``.
    """
    power, block = 1, mixed(ids.astype(np.uint64) * _LEFT + _RIGHT)  # hash of the words at i .. i + power - 1
    for low, high, width in scales(len(ids) // MIN_REPEATS):
        end = longest(low)
        if end < MIN_REPEATS * low:
            return
        while power * 2 <= high:
            block = mixed(block[:-power] * _LEFT + (block[power:] ^ _RIGHT) * _RIGHT)
            power *= 2
        count = end - high + 1
        rest = high - power
        grams = mixed(block[:count] * _LEFT + block[rest : rest + count] * _RIGHT)
        places = _minimizers(grams, width)
        order = np.argsort(grams[places], kind="stable")
        places, values = places[order], grams[places][order]
        lags = places[1:] - places[:-1]
        near = (values[1:] == values[:-1]) & (lags >= low) & (lags <= high)
        yield places[:-1][near], lags[near]


def _first_difference(ids: np.ndarray, at: int, lag: int) -> int:
    """Least i >= ``at`` whose word is not the one ``lag`` further on."""
    step = 64
    while True:
        ahead = ids[at + lag : at + lag + step]
        differs = np.flatnonzero(ids[at : at + len(ahead)] != ahead)
        if len(differs):
            return at + int(differs[0])
        at += len(ahead)
        if len(ahead) < step:
            return at
        step = min(step * 2, 1 << 16)


def _last_difference(ids: np.ndarray, at: int, lag: int) -> int:
    """Greatest i < ``at`` whose word is not the one ``lag`` further on, or -1."""
    step = 64
    while at > 0:
        low = max(0, at - step)
        differs = np.flatnonzero(ids[low:at] != ids[low + lag : at + lag])
        if len(differs):
            return low + int(differs[-1])
        at = low
        step = min(step * 2, 1 << 16)
    return -1


def _least_length(period: int) -> int:
    return max(MIN_LENGTH, MIN_REPEATS * period)


def _is_smallest(ids: np.ndarray, start: int, period: int) -> bool:
    """Whether the ``period`` words from ``start`` on are no repetition of a shorter stretch.

    A run holds its period at least three times, so a smaller period of it would divide this one.
    """
    word = ids[start : start + period]
    rest, prime = period, 2
    while rest > 1:
        if prime * prime > rest:
            prime = rest
        if rest % prime == 0:
            lag = period // prime
            if np.array_equal(word[lag:], word[:-lag]):
                return False
            while rest % prime == 0:
                rest //= prime
        prime += 1
    return True


def _scanned(ids: np.ndarray, period: int) -> Iterator[tuple[int, int]]:
    """Start and end of every stretch in which words ``period`` apart are the same, long enough for a run."""
    same = np.flatnonzero(ids[period:] == ids[:-period])
    if not len(same):
        return
    breaks = np.flatnonzero(np.diff(same) != 1)
    first = np.concatenate([same[:1], same[breaks + 1]])
    last = np.concatenate([same[breaks], same[-1:]])
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        if b + 1 - a + period >= _least_length(period):
            yield a, b + 1


def _all_runs(ids: np.ndarray, longest: Callable[[int], int]) -> Iterator[Run]:
    for period in range(1, min(LAGS, max(0, len(ids) - 1)) + 1):
        for start, end in _scanned(ids, period):
            if _is_smallest(ids, start, period):
                yield start, end - start + period, period
    for places, lags in _seeds(ids, longest):
        order = np.lexsort((places, lags))
        known, upto = 0, -1  # the lag looked at, and how far its stretches are known
        for place, lag in zip(places[order].tolist(), lags[order].tolist(), strict=True):
            if lag != known:
                known, upto = lag, -1
            if place < upto:
                continue
            end = _first_difference(ids, place, lag)
            start = _last_difference(ids, place, lag) + 1
            upto = max(end, place + 1)
            if end - start + lag >= _least_length(lag) and _is_smallest(ids, start, lag):
                yield start, end - start + lag, lag


def find_runs(texts: list[list[bytes]]) -> list[list[Run]]:
    """Every text's runs by start, then period, from its words.

    Texts stand one after the other, longest first, each behind a word of its own that equals no other, so that
    nothing repeats across texts and a scale looks only at texts long enough for it.
    """
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    names: dict[bytes, int] = {}
    ids = np.empty(sum(map(len, texts)) + len(texts) + 1, np.int64)
    starts = np.empty(len(texts) + 1, np.int64)
    at = 0
    for rank, i in enumerate(order):
        ids[at] = -1 - rank
        starts[rank] = at + 1
        at += 1 + len(texts[i])
        ids[starts[rank] : at] = [names.setdefault(w, len(names)) for w in texts[i]]
    ids[at] = -1 - len(texts)
    starts[-1] = at + 1
    lengths = np.array([len(texts[i]) for i in order], np.int64)

    def longest(period: int) -> int:
        """Ids up to the last text that can hold ``MIN_REPEATS`` periods."""
        return int(starts[np.searchsorted(-lengths, -MIN_REPEATS * period, "right")]) - 1

    found: list[list[Run]] = [[] for _ in texts]
    for start, length, period in _all_runs(ids, longest):
        rank = int(np.searchsorted(starts, start, "right")) - 1
        found[order[rank]].append((start - int(starts[rank]), length, period))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def collapse(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep).tolist()]
    return b" ".join(words)


def _finder(id_type: pa.DataType):
    schema = pa.schema([("id", id_type), ("n_words", pa.int64()), ("runs", RUNS_TYPE), ("collapsed", pa.string())])

    def results(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = find_runs(texts)
        flat = np.array([r for runs in found for r in runs], np.int64).reshape(-1, 3)
        ends = np.cumsum([0] + [len(runs) for runs in found]).astype(np.int32)
        runs = pa.ListArray.from_arrays(
            pa.array(ends), pa.StructArray.from_arrays([pa.array(c) for c in flat.T], fields=list(RUNS_TYPE.value_type))
        )
        collapsed = [collapse(w, r).decode("utf-8", "replace") for w, r in zip(texts, found, strict=True)]
        return pa.record_batch(
            [
                pa.array(ids, id_type),
                pa.array([len(w) for w in texts], pa.int64()),
                runs.cast(RUNS_TYPE),
                pa.array(collapsed, pa.string()),
            ],
            schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                words = split_words(text.as_py())
                if texts and size + len(words) > JOINT_WORDS:
                    yield results(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(key)
                texts.append(words)
                size += len(words) + 1
        if texts:
            yield results(ids, texts)

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's periodic runs and its text without their repetitions.

    A run is a longest stretch of consecutive words in which words ``period`` apart are the same, ``period`` being the
    smallest such number, of at least ``MIN_LENGTH`` words and ``MIN_REPEATS`` periods. Periods up to ``LAGS`` are
    found by comparing all words at that distance. Longer ones fall into scales: at each, the minima of word windows
    are taken by the hash of their n-grams, consecutive equal minimizers a period of that scale apart are seeds, and a
    seed is extended word by word as far as the words agree, so hashes decide nothing about a result (two different
    n-grams of one text with equal 64-bit hashes could hide a seed). Documents are searched whole, many short ones
    in one step, without any shuffle; a task needs memory in proportion to its longest text.

    Returns ``id_col``, ``n_words``, ``runs`` (array of start, length, period; by start, then period) and
    ``collapsed`` (the words that no run contains after its first period, joined by one space). Null text counts
    as empty, without runs and with empty ``collapsed``; null ids and repeated rows are kept, each on its own;
    an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    kind = docs.schema[id_col].dataType
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _finder(to_arrow_type(kind)),
        StructType(
            [StructField("id", kind), *StructType.fromDDL(f"n_words long, runs array<{RUN}>, collapsed string").fields]
        ),
    )
    return out.withColumnRenamed("id", id_col)


def strongest_run(runs: str = "runs") -> Column:
    """The run of greatest length over period, compared exactly; the earliest, then shortest period, on ties."""

    def better(best: Column, run: Column) -> Column:
        # runs come by start, then period, so the first of equals stays
        more = run["length"] * best["period"] > best["length"] * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast(RUN), better)


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents of which one in ten, chosen by the CRC-32 of its id, repeats a period from some word on.

    With h the CRC-32 of the id's decimal text, g = floor(h / 10) and n words: where h is divisible by 10, every
    word i >= a becomes word a + (i - a) mod p, a = g mod n, p = 1 + floor((n - a) / (3 + g mod 8)). Others, and
    rows without id or words, stay as they are.
    """
    text = F.col(text_col).cast("string")
    words = F.filter(F.split(text, WORD_SPLIT), lambda w: w != "")
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    shaped = docs.select(
        F.col(id_col).alias("id"),
        text.alias("text"),
        F.floor(h / 10).cast("long").alias("g"),
        F.when(h % 10 == 0, words).alias("words"),
    )
    n, g = F.size("words"), F.col("g")
    first = (g % n).cast("int")
    period = (F.lit(1) + F.floor((n - F.col("first")) / (F.lit(3) + g % 8))).cast("int")
    index = F.sequence(F.lit(0), n - 1)
    moved = F.transform(
        index,
        lambda i: F.element_at(
            F.col("words"),
            (F.when(i < F.col("first"), i).otherwise(F.col("first") + (i - F.col("first")) % F.col("period")) + 1).cast("int"),
        ),
    )
    return (
        shaped.withColumn("first", F.when(n > 0, first))
        .withColumn("period", period)
        .select(
            F.col("id").alias(id_col),
            F.when(n > 0, F.array_join(moved, " ")).otherwise(F.col("text")).alias(text_col),
        )
    )
