"""Words and their 64-bit hashes, as used inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

# Entries a worker keeps, some 50 to 100 MB; beyond it the cache starts anew, which costs time and changes no result.
CACHE_ENTRIES = 400_000
_held: list[dict] = []  # the cache that this worker's latest task uses
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library on Linux
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def hold(cache: dict) -> None:
    """Keep this cache and drop the one of an earlier stage: workers live on between stages, and one cache at most with them."""
    if not _held or _held[0] is not cache:
        for other in _held:
            other.clear()
        _held[:] = [cache]


def settle() -> None:
    """At a task's end: give free memory back, as the worker stays while other stages run."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def forget() -> None:
    """At the end of a task whose stage needs no cache: empty what the worker holds."""
    for cache in _held:
        cache.clear()
    settle()


class HashCache(dict):
    """Word (bytes) to its 64-bit hash, computed on first use."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_cache = HashCache()  # workers live on between tasks


def word_hashes(words: list[bytes]) -> np.ndarray:
    return _cache.of(words)


def forget_words() -> None:
    """At the end of a task that uses ``word_hashes``: empty every cache, as hashing a word anew costs little."""
    hold(_cache)
    forget()


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores behind it until no column has it; Spark takes letter case for nothing."""
    taken = {c.lower() for c in columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def split_words(text: str | None) -> list[bytes]:
    """Maximal runs without space, tab, line feed, vertical tab, form feed or carriage return.

    ``bytes.split`` knows exactly these six separators, ``str.split`` knows more.
    """
    return (text or "").encode("utf-8", "surrogatepass").split()


def lower_words(text: str | None) -> list[bytes]:
    """The words with A-Z lower-cased and every other character as it is."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words, by place."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:count].copy()
    for i in range(1, width):
        out *= _STEP
        out += hashes[i : i + count]
    return mixed(out)


# Every byte's place in a word's hash: A-Z as a-z, and nothing for the six separators.
_SEPARATORS = b"\x20\x09\x0a\x0b\x0c\x0d"
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_BYTE_VALUES = mixed(_LOWER.astype(np.uint64) * _STEP + _STEP)
_BLANK = np.isin(np.arange(256), list(_SEPARATORS))
_BYTE_VALUES[_BLANK] = 0
_BASE = 0x9FB21C651E98DF25  # odd, so that it has an inverse
_PIECE = 1 << 18  # bytes hashed in one step
_to_blank = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, count: int) -> np.ndarray:
    """Powers of ``base`` from 0 on, as many as asked for and at least a piece's."""
    known = _powers.get(base)
    if known is None or len(known) < count:
        steps = np.full(max(count, _PIECE), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base][:count]


def _hashes_of(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word: a polynomial of its lower-cased bytes, wherever it stands."""
    raw = np.frombuffer(data, np.uint8)
    edge = np.diff(~_BLANK[raw], prepend=False, append=False)
    starts, ends = np.flatnonzero(edge).reshape(-1, 2).T
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[raw] * _power(_BASE, len(raw)), out=sums[1:])
    moved = (sums[ends] - sums[starts]) * _power(pow(_BASE, -1, 1 << 64), len(raw))[starts]
    return mixed(moved + (ends - starts).astype(np.uint64)), starts


def hashed_texts(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Hashes of every text's lower-cased words, many texts in one step; a long text in pieces that end at a blank."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if len(data) > _PIECE:
            yield from _hashed_together(held)
            held, size = [], 0
            yield _hashed_long(data.translate(_to_blank))
            continue
        if size + len(data) >= _PIECE:
            yield from _hashed_together(held)
            held, size = [], 0
        held.append(data)
        size += len(data) + 1
    yield from _hashed_together(held)


def _hashed_together(texts: list[bytes]) -> Iterator[np.ndarray]:
    if texts:
        hashes, starts = _hashes_of(b" ".join(texts))
        ends = np.cumsum([len(t) + 1 for t in texts])
        yield from np.split(hashes, np.searchsorted(starts, ends[:-1]))


def _hashed_long(data: bytes) -> np.ndarray:
    parts, at = [], 0
    while at < len(data):
        end = len(data) if len(data) - at <= _PIECE else data.rfind(b" ", at, at + _PIECE)
        if end <= at:  # one word longer than a piece
            end = data.find(b" ", at + 1)
            end = len(data) if end < 0 else end
        parts.append(_hashes_of(data[at:end])[0])
        at = end
    return np.concatenate(parts)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples of Python values."""
    for batch in batches:
        yield from zip(*(batch.column(name).to_pylist() for name in names), strict=True)


def batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    """Tuples as Arrow batches of bounded length."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)
    settle()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
