"""Lexical retrieval packing: a sharded BM25 index fills each seed's window with unused neighbours."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from steepgrid.llm.words import batched, forget, hold, rows_of
from steepgrid.session import materialise

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
WINDOW = 4096
SHARD_TOKENS = 2_000_000
K1, B = 1.2, 0.75
JOINED = 500  # units encoded as one text
CHUNKS = 800_000  # a worker keeps the ids of; beyond it the cache starts anew
LIVE = 0.7  # an index with a smaller part of unused documents is thinned out to these
FIRST = 128  # best neighbours that are ordered before the others

# The vocabulary's pattern for lower-cased Latin-1 text.
_LETTERS, _DIGITS, _BLANKS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", r"\t\n\v\f\r \x85\xa0"
_UNITS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_BLANKS}{_LETTERS}{_DIGITS}]+")

_TOKEN_ROWS = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("sketch", pa.int64())])
_PIECES = pa.schema(
    [("id", pa.int64())]
    + [(name, pa.int64()) for name in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
)


_caches: dict[str, "ChunkIds"] = {}  # one per tokenizer and worker; workers live on between tasks


def chunk_ids(path: str) -> "ChunkIds":
    if path not in _caches:
        _caches[path] = ChunkIds(path)
    hold(_caches[path])
    return _caches[path]


class ChunkIds(dict):
    """Ids of a unit: a word, a digit or a run of signs, as the vocabulary's own pattern cuts them.

    The vocabulary drops white space and encodes units apart. A unit of Latin-1 letters needs no normalising once it is
    lower-cased, so new units go to the model alone; a chunk with any other character goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.by_model: dict[bool, Tokenizer] = {}  # whether units are printable ASCII, which stands for its own bytes
        self.path = path

    def _load(self) -> None:
        """What only tasks need; the driver asks for the vocabulary alone."""
        tokens = map(self.tokenizer.id_to_token, range(self.tokenizer.get_vocab_size()))
        self.ends = np.array([(token or "").endswith("</w>") for token in tokens])
        blanks = pre_tokenizers.WhitespaceSplit()
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        for printable, steps in ((True, [blanks]), (False, [blanks, as_bytes])):
            model = Tokenizer.from_file(self.path)
            model.normalizer, model.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.Sequence(steps)
            self.by_model[printable] = model

    def units(self, text: str) -> list[str]:
        if "<|" not in text and _latin(text):
            return _UNITS.findall(text.lower())
        found = []
        for chunk in text.replace("\n", " ").split(" "):
            if "<|" not in chunk and _latin(chunk):
                found += _UNITS.findall(chunk.lower())
            else:
                found.append(chunk)
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_model:
            self._load()
        cut = [self.units(text) for text in texts]
        if len(self) >= CHUNKS:
            self.clear()
        new = set().union(*cut).difference(self)
        plain: dict[bool, list[str]] = {True: [], False: []}
        odd = []
        for unit in new:
            if "<|" in unit or not _latin(unit):
                odd.append(unit)
            else:
                plain[unit.isascii() and unit.isprintable()].append(unit)
        for printable, units in plain.items():
            self._encode_units(units, self.by_model[printable])
        for unit in odd:
            self[unit] = np.array(self.tokenizer.encode(unit, add_special_tokens=False).ids, self.kind).tobytes()
        return [np.frombuffer(b"".join(map(self.__getitem__, units)), self.kind) for units in cut]

    def _encode_units(self, units: list[str], model: Tokenizer) -> None:
        """Encode many units in few calls, apart by a blank, and part the ids behind those that end a unit."""
        joined = [" ".join(units[at : at + JOINED]) for at in range(0, len(units), JOINED)]
        got = [np.array(x.ids, self.kind) for x in model.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.concatenate([*got, np.zeros(0, self.kind)])
        stops = ((np.flatnonzero(self.ends[ids]) + 1) * self.kind.itemsize).tolist()
        data = ids.tobytes()
        self.update(zip(units, map(data.__getitem__, map(slice, [0, *stops], stops)), strict=True))


def _latin(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeError:
        return False


def encode_texts(cache: ChunkIds, texts: list[str | None], end_id: int | None) -> list[np.ndarray]:
    """Each text's ids, then ``end_id`` if one is given."""
    found = cache.encode([t or "" for t in texts])
    if end_id is None:
        return found
    tail = np.array([end_id], cache.kind)
    return [np.concatenate([ids, tail]) for ids in found]


def _tokenise(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = chunk_ids(path)
        orders = np.random.default_rng(0).permuted(np.tile(np.arange(1 << 16, dtype=np.int64), (2, 1)), axis=1)
        one, two = orders.astype(np.uint16)

        def rows():
            for batch in batches:
                ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
                for at in range(0, len(texts), 256):
                    for key, got in zip(ids[at:], encode_texts(cache, texts[at : at + 256], end_id), strict=False):
                        low = got & 0xFFFF
                        yield key, len(got), got.tobytes(), int(one[low].min()) << 16 | int(two[low].min())

        yield from batched(rows(), _TOKEN_ROWS, 512)

    return run


def _document_frequencies(kind: np.dtype, vocabulary: int):
    schema = pa.schema([("term", pa.int32()), ("df", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, seen = np.zeros(vocabulary, np.int64), np.zeros(vocabulary, bool)
        for (ids,) in rows_of(batches, "ids"):
            seen[np.frombuffer(ids, kind)] = True
            found = np.flatnonzero(seen)
            df[found] += 1
            seen[found] = False
        terms = np.flatnonzero(df)
        yield pa.record_batch([pa.array(terms, pa.int32()), pa.array(df[terms])], schema=schema)

    return run


def _falling(score: np.ndarray) -> Iterator[int]:
    """Places of all scores but zero, the highest first, equal ones in order; most callers need the first few."""
    found = np.flatnonzero(score)
    if len(found) > 2 * FIRST:
        least = np.partition(score[found], len(found) - FIRST)[len(found) - FIRST]
        first = score[found] >= least
        parts = (found[first], found[~first])
    else:
        parts = (found,)
    for part in parts:
        yield from part[np.argsort(-score[part], kind="stable")]


def pack_shard(docs: list[tuple], idf: np.ndarray, mean_tokens: float, window: int) -> Iterator[tuple]:
    """Pieces (document place, start, length, sequence, offset) of one shard's documents.

    ``docs`` holds an id array each. Full windows of a long document stand alone; what is left of
    every document is indexed by BM25 over its ids. The longest unused rest seeds a window, all its document's
    terms query the index, and unused neighbours fill the window by falling score; the last
    one is cut and its rest stays in the index. Without a scoring neighbour the next unused document
    in shard order follows. Only the shard's last window can stay open; it is cut into sequences
    whose lengths are powers of two.
    """
    size = [len(ids) for ids in docs]
    start, left = np.zeros(len(docs), np.int64), np.array(size, np.int64)
    sequence = 0
    for d, n in enumerate(size):
        for k in range(n // window):
            yield d, k * window, window, sequence, 0
            sequence += 1
        start[d] = n // window * window
    left -= start
    if not left.any():
        return
    open_docs = np.flatnonzero(left)
    lengths = np.array(size, np.int64)[open_docs]
    every, owner = np.concatenate([docs[d] for d in open_docs]), np.repeat(open_docs, lengths)
    by_term = np.argsort(every.astype(np.uint16) if len(idf) <= 1 << 16 else every, kind="stable")
    every, owner = every[by_term], owner[by_term]
    new = np.flatnonzero(np.concatenate([[True], (every[1:] != every[:-1]) | (owner[1:] != owner[:-1])]))
    tf = np.diff(new, append=len(every))
    term, holder = every[new].astype(np.int64), owner[new]
    norm = K1 * (1 - B + B * np.array(size) / mean_tokens)
    entry = np.dtype([("holder", np.int32), ("weight", np.float32)])
    entries = np.empty(len(term), entry)
    entries["holder"], entries["weight"] = holder, idf[term] * tf * (K1 + 1) / (tf + norm[holder])
    entries = entries.view(np.int64)  # numbers are copied faster than records
    bounds = np.searchsorted(term, np.arange(len(idf) + 1))
    live = len(open_docs)
    found = np.empty_like(entries)  # of a query's lists

    shard_order, seeds = 0, iter(np.argsort(-left, kind="stable"))
    remaining = int(left.sum())
    pieces: list[tuple[int, int, int]] = []
    room = window

    def take(d: int) -> None:
        nonlocal room, remaining
        n = min(room, int(left[d]))
        pieces.append((d, int(start[d]), n))
        start[d] += n
        left[d] -= n
        room -= n
        remaining -= n

    while remaining:
        pieces, room = [], window
        seed = next((d for d in seeds if left[d]), None)
        if seed is None:  # rests of cut documents
            seed = int(np.argmax(left))
        take(int(seed))
        unused = left > 0
        if unused.sum() < LIVE * live:
            live = int(unused.sum())
            kept = unused[entries.view(entry)["holder"]]
            bounds = np.concatenate([[0], np.cumsum(kept)])[bounds]
            entries = entries[kept]
        query = np.unique(docs[seed]).astype(np.int64)
        starts, stops = bounds[query], bounds[query + 1]
        starts, stops = starts[stops > starts], stops[stops > starts]
        apart = starts[1:] != stops[:-1]  # lists that adjoin are read as one
        starts, stops = starts[np.append(True, apart)[: len(starts)]], stops[np.append(apart, True)[: len(stops)]]
        score = np.zeros(len(docs))
        if len(starts):
            held = found[: (stops - starts).sum()]
            np.concatenate([entries[a:b] for a, b in zip(starts.tolist(), stops.tolist())], out=held)
            score = np.bincount(held.view(entry)["holder"], held.view(entry)["weight"], len(docs))
        score[~unused] = 0
        for d in _falling(score):
            if not room:
                break
            take(int(d))
        while room and remaining:
            while not left[shard_order]:
                shard_order += 1
            take(shard_order)
        if not room:
            offset = 0
            for d, s, n in pieces:
                yield d, s, n, sequence, offset
                offset += n
            sequence += 1
        else:
            filled, free = window - room, 0
            offset = 0
            for d, s, n in pieces:
                while n:
                    if not free:
                        free = 1 << (filled.bit_length() - 1)
                        filled -= free
                        offset = 0
                    part = min(n, free)
                    yield d, s, part, sequence, offset
                    s, n, free, offset = s + part, n - part, free - part, offset + part
                    if not free:
                        sequence += 1


def _pack(idf, mean_tokens: float, window: int, kind: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(rows_of(batches, "id", "ids", "sketch"), key=lambda r: (r[2], r[0] is not None, r[0] or 0, r[1]))
        docs = [np.frombuffer(ids, kind) for _, ids, _ in rows]
        base = TaskContext.get().partitionId() << 32

        def pieces():
            for d, start, length, sequence, offset in pack_shard(docs, idf.value, mean_tokens, window):
                crc = zlib.crc32(docs[d][start : start + length].astype("<u4").tobytes())
                yield rows[d][0], start, length, crc, len(docs[d]), base + sequence, offset

        yield from batched(pieces(), _PIECES)
        forget()  # all texts are encoded by now

    return run


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = TOKENIZER,
    end_id: int = END_ID,
    window: int = WINDOW,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Pack all documents into sequences of at most ``window`` tokens, lexical neighbours together.

    Document frequencies of the vocabulary's ids are counted over all documents (a vector of fixed
    length). Documents are range-partitioned by a two-value min-hash sketch of their ids, then id, into shards of
    about ``shard_tokens`` tokens whatever the corpus size: near texts meet in a shard, and a hot sketch
    is cut by id, and equal ids by the row's number, over many shards. Each shard holds one BM25 index (see ``pack_shard``).

    Returns one row per piece: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset``.
    Null or empty text is one token, ``end_id``. A very long text is cut into whole windows plus a rest.
    Repeated rows and null ids are packed as rows of their own. An empty table gives no pieces; other columns
    are ignored. Ids must be integers.
    """
    spark = docs.sparkSession
    cache = chunk_ids(tokenizer)
    kind, vocabulary = cache.kind, max(cache.tokenizer.get_vocab_size(), end_id + 1)
    tokens = materialise(
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
            _tokenise(tokenizer, end_id), "id long, n long, ids binary, sketch long"
        ).withColumn("row", F.monotonically_increasing_id()),
        "token-ids",
    )
    size = tokens.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    counted = (
        tokens.select("ids")
        .mapInArrow(_document_frequencies(kind, vocabulary), "term int, df long")
        .groupBy("term")
        .agg(F.sum("df").alias("df"))
        .toPandas()  # at most one row per vocabulary id
    )
    df = np.zeros(vocabulary)
    df[counted["term"].to_numpy()] = counted["df"].to_numpy()
    idf = spark.sparkContext.broadcast(np.log1p((size["rows"] - df + 0.5) / (df + 0.5)).astype(np.float32))
    shards = max(1, -(-size["tokens"] // shard_tokens))
    mean = size["tokens"] / max(1, size["rows"])
    pieces = tokens.repartitionByRange(shards, "sketch", F.col("id").asc_nulls_first(), "row").mapInArrow(
        _pack(idf, mean, window, kind),
        "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
    return pieces.withColumnRenamed("id", id_col)
