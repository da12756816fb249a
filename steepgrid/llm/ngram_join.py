"""Jaccard self-join of word shingles by T-occurrence search."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from steepgrid.llm.linking import components, probably_in
from steepgrid.llm.words import batched, hashed_texts, mixed, rows_of, settle, unused, window_hashes
from steepgrid.session import materialise

WIDTH = 5
PERCENT = 75
BLOCK = 512  # documents of one inverted index
QUERIES = 256  # queries that one index answers in one unit of work
COUNTED = 1_000_000  # shingles sorted together
KEY_BYTES = 5  # of a shingle's hash, kept while repeated shingles are looked for
GAP_BYTES = 3  # of the step from one sorted key to the next; a longer step takes several
RANGES = 1024  # parts of the key space, counted one after the other
COUNTERS = 64  # tasks that count them
MAP_BITS = 27  # size of the map of repeated shingles: 16 MB whatever the input
LONG = 1.0  # weight of the list length in choosing how many lists are probed
PROBES = 8192  # looked up in one step

_SET_ROWS = pa.schema(
    [("id", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("prefix", pa.list_(pa.int64()))]
    + [("shingles", pa.binary()), ("parity", pa.binary())]
)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a shorter text is one shingle."""
    return next(shingle_sets([text], width))


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """``shingles`` of every text."""
    for hashes in hashed_texts(texts):
        if 0 < len(hashes) < width:
            yield window_hashes(hashes, len(hashes)) ^ np.uint64(len(hashes))
            continue
        found = np.sort(window_hashes(hashes, width))
        yield found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found


def parity(found: np.ndarray) -> bytes:
    """A set's bit map, about a bit a shingle: a bit is set if an odd number of shingles falls on its place."""
    size = max(64, 1 << (len(found) - 1).bit_length())
    counts = np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def set_id(found: np.ndarray) -> int:
    """A number that stands for the whole set."""
    both = np.array([np.bitwise_xor.reduce(found), found.sum(dtype=np.uint64) + np.uint64(len(found))], np.uint64)
    one, two = mixed(both)
    return int((one ^ (two << np.uint64(1))).astype(np.int64))


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """Shingles that a document of n must share with any partner."""
    return -(-percent * n // 100)


def packed_gaps(keys: np.ndarray, start: int) -> bytes:
    """Sorted keys from ``start`` on as steps of GAP_BYTES; the greatest step stands for no key."""
    longest = (1 << 8 * GAP_BYTES) - 1
    gaps = np.diff(keys.astype(np.int64), prepend=start)
    more = gaps // longest
    steps = np.full(len(gaps) + int(more.sum()), longest, np.int64)
    steps[np.arange(len(gaps)) + np.cumsum(more)] = gaps % longest
    return steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :GAP_BYTES].tobytes()


def unpacked_gaps(blob: bytes, start: int) -> np.ndarray:
    raw = np.zeros((len(blob) // GAP_BYTES, 8), np.uint8)
    raw[:, :GAP_BYTES] = np.frombuffer(blob, np.uint8).reshape(-1, GAP_BYTES)
    steps = raw.view("<u8").ravel()
    return (np.cumsum(steps) + np.uint64(start))[steps != (1 << 8 * GAP_BYTES) - 1]


def _keys(width: int):
    """Leading bytes of all sets' shingles, sorted and cut into ranges; an equal neighbour marks a repeated one."""
    schema = pa.schema([("range", pa.int32()), ("keys", pa.binary())])

    def cut(held: list[np.ndarray]):
        keys = np.concatenate(held)
        keys >>= np.uint64(64 - 8 * KEY_BYTES)
        keys.sort()
        # twice is as good as often
        keys = keys[np.concatenate([[True, True], keys[2:] != keys[:-2]])[: len(keys)]]
        step = (1 << 8 * KEY_BYTES) // RANGES
        bounds = np.searchsorted(keys, np.arange(1, RANGES, dtype=np.uint64) * np.uint64(step))
        parts = [packed_gaps(x, i * step) for i, x in enumerate(np.split(keys, bounds))]
        return pa.record_batch([pa.array(range(RANGES), pa.int32()), pa.array(parts, pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        seen: set[int] = set()
        for found in (x for batch in batches for x in shingle_sets(batch.column("text").to_pylist(), width)):
            if not len(found) or (sid := set_id(found)) in seen:
                continue
            seen.add(sid)
            held.append(found)
            size += len(found)
            if size >= COUNTED:
                yield cut(held)
                held, size = [], 0
        if held:
            yield cut(held)
        settle()

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range, the part of the map whose bits stand for keys that come at least twice.

    Keys wait until they are as many as those sorted before, so that a key is sorted a few times at most.
    """
    schema = pa.schema([("range", pa.int32()), ("bits", pa.binary())])
    rows = rows_of(batches, "range", "keys")
    for number, blobs in groupby(rows, key=lambda r: r[0]):
        bits = np.zeros((1 << MAP_BITS) // RANGES, bool)
        once = np.zeros(0, np.uint64)

        def counted(once: np.ndarray, waiting: list[np.ndarray]) -> np.ndarray:
            once = np.sort(np.concatenate([once, *waiting]), kind="stable")
            again = once[1:] == once[:-1]
            bits[_place(once[1:][again]) - number * len(bits)] = True
            return once[np.concatenate([[True], ~again])] if len(once) else once

        waiting, size = [], 0
        for _, blob in blobs:
            waiting.append(unpacked_gaps(blob, number * ((1 << 8 * KEY_BYTES) // RANGES)))
            size += len(waiting[-1])
            if size > len(once):
                once = counted(once, waiting)
                waiting, size = [], 0
        counted(once, waiting)
        yield pa.record_batch([pa.array([number], pa.int32()), pa.array([np.packbits(bits).tobytes()])], schema=schema)
    settle()


def _place(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(8 * KEY_BYTES - MAP_BITS)).astype(np.int64)


def _prefixes(width: int, percent: int, repeated):
    """Every row's set; a set that may have a partner with its prefix and its shingles, once in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(repeated.value, np.uint8)
        seen: set[int] = set()

        def rows():
            sets = (
                x
                for batch in batches
                for x in zip(batch.column("id").to_pylist(), shingle_sets(batch.column("text").to_pylist(), width), strict=True)
            )
            for key, found in sets:
                n = len(found)
                if not n:
                    yield key, 0, None, None, None, None
                    continue
                sid = set_id(found)
                if sid not in seen:
                    seen.add(sid)
                    place = _place(found >> np.uint64(64 - 8 * KEY_BYTES))
                    shared = found[(bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1]
                    spare = len(shared) - least_overlap(n, percent)
                    if spare >= 0:
                        shared = np.sort(mixed(shared))[: spare + 1]
                        yield key, n, sid, shared.view(np.int64).tolist(), found.tobytes(), parity(found)
                        continue
                yield key, n, sid, None, None, None

        yield from batched(rows(), _SET_ROWS, 256)

    return run


class Index:
    """Inverted lists of a block of sets, held as one ascending array of (shingle's place, set's place)."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        every = every[order]
        new = np.concatenate([[True], every[1:] != every[:-1]])
        self.keys, starts = every[new], np.flatnonzero(new)
        self.bounds = np.append(starts, len(every))
        self.holders = np.repeat(np.arange(len(sets)), self.sizes)[order]  # ascending inside a list
        self.entries = (np.cumsum(new) - 1) * len(sets) + self.holders

    def search(self, query: np.ndarray, percent: int) -> np.ndarray:
        """Places of the sets whose Jaccard similarity with the query is at least ``percent``.

        DivideSkip: the longest lists are set aside. The short ones are merged, counting each set; a set that misses
        more than the number of lists set aside cannot reach the needed overlap. What is left is looked
        up in the long lists by binary search, many lists in one step.
        """
        at = np.minimum(np.searchsorted(self.keys, query), len(self.keys) - 1)
        at = at[self.keys[at] == query]
        n = len(query)
        need = least_overlap(n, percent)
        if len(at) < need:
            return np.empty(0, np.int64)
        lengths = self.bounds[at + 1] - self.bounds[at]
        aside = min(need - 1, int(need / (LONG * np.log2(lengths.max() + 1) + 1)), len(at) - 1)
        order = np.argsort(lengths, kind="stable")
        cut = len(at) - aside
        short, long = at[order[:cut]], at[order[cut:]]
        counts = np.bincount(self._merged(short, lengths[order[:cut]]), minlength=len(self.sizes))
        able = (100 * self.sizes >= percent * n) & (100 * n >= percent * self.sizes) & (counts >= max(1, need - aside))
        left = np.flatnonzero(able)
        # overlap >= percent / (100 + percent) of both sizes together
        needed = -(-percent * (n + self.sizes[left]) // (100 + percent))
        got = counts[left]
        done = 0
        while done < aside and len(left):
            some = long[done : done + max(1, PROBES // len(left))]
            wanted = (some[:, None] * len(self.sizes) + left).ravel()
            found = np.minimum(np.searchsorted(self.entries, wanted), len(self.entries) - 1)
            got = got + (self.entries[found] == wanted).reshape(len(some), -1).sum(axis=0)
            done += len(some)
            able = got + (aside - done) >= needed  # drop what can no longer reach its overlap
            left, got, needed = left[able], got[able], needed[able]
        return left[got >= needed]

    def _merged(self, lists: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The sets of all the lists, one after the other."""
        before = np.cumsum(lengths) - lengths
        return self.holders[np.arange(lengths.sum()) + np.repeat(self.bounds[lists] - before, lengths)]


def _search(percent: int):
    """Links found in each unit: one index, its queries, and no more links than join what is connected."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(unit: list[tuple]):
        members = [r for r in unit if not r[2]]
        asked = [r for r in unit if r[2]]
        if not members or not asked:
            return
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for r in unit:  # what is connected already needs no link
            root[find(r[3])] = find(r[4])
        index = Index([np.frombuffer(r[5], np.uint64) for r in members])
        for r in asked:
            for place in index.search(np.frombuffer(r[5], np.uint64), percent):
                one, two = find(r[3]), find(members[place][3])
                if one != two:
                    root[one] = two
                    yield r[3], members[place][3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = rows_of(batches, "unit", "part", "asks", "sid", "label", "shingles")
        yield from batched((x for _, unit in groupby(rows, key=lambda r: r[:2]) for x in links(list(unit))), schema)

    return run


def _foldings(maps: np.ndarray, levels: int) -> Iterator[np.ndarray]:
    """Parity maps at their own size, then halved up to ``levels`` times."""
    yield maps
    for _ in range(levels):
        half = maps.shape[-1] // 2
        if not half:
            return
        maps = maps[..., :half] ^ maps[..., half:]
        yield maps


def _plausible(percent: int):
    """Rows of each unit that may have a link in it.

    Two sets differ in at least as many shingles as their parity maps in bits, and linked sets in at most
    (100 - percent) / (100 + percent) of their sizes' sum.
    """
    schema = pa.schema([(name, pa.int64()) for name in ("unit", "part", "sid", "label")] + [("asks", pa.bool_())])
    levels = int(np.log2(100 / percent)) + 1  # linked sets' maps differ by at most so many doublings

    def keep(unit: list[tuple]) -> Iterator[tuple]:
        members = [r for r in unit if not r[2]]
        by_length: dict[int, list[int]] = {}
        for place, r in enumerate(members):
            by_length.setdefault(len(r[6]) // 8, []).append(place)
        stacks = []
        for length, places in by_length.items():
            maps = np.frombuffer(b"".join(members[i][6] for i in places), np.uint64).reshape(-1, length)
            sizes, labels = (np.array([members[i][k] for i in places], np.int64) for k in (5, 4))
            for fold, some in enumerate(_foldings(maps, levels)):
                stacks.append((some.shape[1], fold, some, np.array(places), sizes, labels))
        used = np.zeros(len(members), bool)
        for r in unit:
            if not r[2]:
                continue
            found = False
            for mine, own in enumerate(_foldings(np.frombuffer(r[6], np.uint64), levels)):
                for length, fold, maps, places, sizes, labels in stacks:
                    if length != len(own) or (fold and mine):  # only the larger one is folded
                        continue
                    differ = np.bitwise_count(maps ^ own).sum(axis=1, dtype=np.int64)
                    able = (differ * (100 + percent) <= (sizes + r[5]) * (100 - percent)) & (labels != r[4])
                    used[places[able]] = True
                    found = found or bool(able.any())
            if found:
                yield r[0], r[1], r[3], r[4], True
        for place in np.flatnonzero(used):
            r = members[place]
            yield r[0], r[1], r[3], r[4], False

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = rows_of(batches, "unit", "part", "asks", "sid", "label", "n", "parity")
        yield from batched((x for _, unit in groupby(rows, key=lambda r: r[:2]) for x in keep(list(unit))), schema)

    return run


def _units(asked: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of search units from (unit, part, sid, label) of queries and members."""
    rows = asked.withColumn("asks", F.lit(True)).unionByName(members.withColumn("asks", F.lit(False)))
    # sets are shuffled to their rows at every size alike, as the rows grow with the input
    rows = (
        rows.hint("merge").join(sets.select("sid", "n", "parity"), "sid")
        .repartition("unit", "part")
        .sortWithinPartitions("unit", "part", "asks", "sid")
        .select("unit", "part", "asks", "sid", "label", "n", "parity")
        .mapInArrow(_plausible(percent), "unit long, part long, sid long, label long, asks boolean")
    )
    rows = materialise(rows, "plausible")
    return (
        probably_in(sets.select("sid", "shingles"), "sid", rows.select("sid"))
        .join(rows.hint("merge"), "sid")
        .repartition("unit", "part")
        .sortWithinPartitions("unit", "part", "asks", "sid")
        .select("unit", "part", "asks", "sid", "label", "shingles")
        .mapInArrow(_search(percent), "a long, b long")
    )


def _by_size(clusters: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Clusters parted by size, so that sets too unlike in size to be linked are not searched together.

    Sizes fall into classes a factor of 100 / percent wide; linked sets are of one class or of neighbours. A set goes to
    the part of its own class and to the next higher; a part is kept if it has a set of its own class and another
    set, so a cluster within one class stays one part.
    """
    width = float(np.log(100 / percent))
    sized = clusters.join(
        sets.select("sid", F.floor(F.log(F.octet_length("shingles") / 8) / F.lit(width)).cast("int").alias("_own")), "sid"
    )
    sized = sized.select("unit", "sid", "_own", F.explode(F.array(F.col("_own"), F.col("_own") + 1)).alias("_class"))
    kept = (
        sized.groupBy("unit", "_class")
        .agg(F.max("_own").alias("_top"), F.count("*").alias("_c"))
        .where((F.col("_top") == F.col("_class")) & (F.col("_c") > 1))
        .select("unit", "_class")
    )
    return sized.join(kept, ["unit", "_class"]).select(F.xxhash64("unit", "_class").alias("unit"), "sid")


def _repeated_map(texts: DataFrame, width: int) -> bytes:
    """The bit map of repeated shingles, put together by the driver; of fixed size."""
    parts = (
        texts.select("text")
        .mapInArrow(_keys(width), "range int, keys binary")
        .repartition(COUNTERS, "range")
        .sortWithinPartitions("range")
        .mapInArrow(_repeated, "range int, bits binary")
        .toArrow()
    )
    bits = bytearray((1 << MAP_BITS) // 8)
    for number, part in zip(parts["range"].to_pylist(), parts["bits"]):
        some = part.as_py()
        bits[number * len(some) : (number + 1) * len(some)] = some
    return bytes(bits)


def join_by_shingles(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = WIDTH,
    percent: int = PERCENT,
) -> DataFrame:
    """Every document's component under links of at least ``percent`` Jaccard similarity of word shingles.

    1. Equal sets are one set from here on. Which shingles more than one set holds is counted over all documents in
       sorted blocks of hash bytes, range by range, and kept in a bit map of fixed size (two shingles may share a
       bit, which lets more through and loses nothing).
    2. A partner shares at least T of a set's n shingles, all of them repeated. A set with fewer repeated shingles
       has no partner. Of m repeated ones, the first m - T + 1 in hash order are the prefix: two linked sets
       share a shingle of both prefixes.
    3. The shingle's least set is its list's centre; a centre's cluster is every set it meets in a list. Two linked
       sets share a list, so they meet in the cluster of its centre. Clusters are parted by size (``_by_size``) and cut
       into blocks; sets whose parity maps rule out every link in a block leave it (``_plausible``), the others become
       an inverted index (``Index.search``). First each cluster's least set is the query. Then, in each cluster,
       only sets outside the cluster's largest component so far ask, and links that connect nothing new are not written.
    4. Components of the links, and each one's least document.

    Returns ``id_col, n_shingles, component_id``. Null and empty texts have no shingles and are their own
    component; a text of fewer words than ``width`` is one shingle; equal texts share a component; a null id counts as
    no smallest id; repeated rows are returned as often as they come; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    repeated = spark.sparkContext.broadcast(_repeated_map(texts, width))
    table = materialise(
        texts.mapInArrow(
            _prefixes(width, percent, repeated),
            "id long, n long, sid long, prefix array<long>, shingles binary, parity binary",
        ),
        "shingle-sets",
    )
    repeated.destroy()  # the sets are written; the driver holds no map while they are joined
    del repeated
    settle()
    rows = table.where("prefix is not null").select("sid", F.explode("prefix").alias("shingle"))
    centres = (
        rows.groupBy("shingle").agg(F.min("sid").alias("unit"), F.max("sid").alias("_other")).where("unit <> _other")
    )
    centres = materialise(centres.select(F.col("shingle").alias("_shingle"), "unit"), "centres")
    clusters = materialise(
        probably_in(rows, "shingle", centres)
        .join(centres, F.col("shingle") == F.col("_shingle"))
        .select("unit", "sid")
        .distinct(),
        "clusters",
    )
    wanted = materialise(clusters.select("sid").distinct(), "wanted-sets")
    sets = (
        probably_in(table.where("prefix is not null").select("sid", "n", "shingles", "parity"), "sid", wanted)
        .join(wanted.hint("merge"), "sid", "left_semi")
        .dropDuplicates(["sid"])
    )
    sets = materialise(sets, "wanted-shingles")
    clusters = materialise(_by_size(clusters, sets, percent), "sized-clusters")
    sizes = clusters.groupBy("unit").agg(F.count("*").alias("_size"))
    parted = clusters.join(sizes, "unit").withColumn(
        "part", F.pmod(F.xxhash64("sid"), F.ceil(F.col("_size") / BLOCK)).cast("long")
    )
    lead = parted.groupBy("unit").agg(F.min("sid").alias("_lead"))
    first = parted.join(lead, "unit").where("sid <> _lead").select("unit", "part", "sid", F.col("sid").alias("label"), "_lead")
    asking = first.select("unit", "part", F.col("_lead").alias("sid"), F.col("_lead").alias("label")).distinct()
    first = first.drop("_lead")
    links = materialise(_units(asking, first, sets, percent), "star-links")
    labels = components(links)

    labelled = parted.join(labels, parted["sid"] == labels["node"], "left").select(
        "unit", "part", "sid", F.coalesce("label", "sid").alias("label"), "_size"
    )
    labelled = materialise(labelled, "labelled-clusters")
    main = (
        labelled.groupBy("unit", "label")
        .agg(F.count("*").alias("_c"))
        .groupBy("unit")
        .agg(F.max_by("label", F.struct("_c", "label")).alias("main"), F.count("*").alias("_labels"))
        .where("_labels > 1")
    )
    open_rows = labelled.join(main, "unit")
    # a query goes to every block of its cluster; queries of one block are cut so that a unit stays small
    slots = F.ceil(F.col("_size") / QUERIES).cast("long")
    blocks = F.ceil(F.col("_size") / BLOCK).cast("long")
    asking = open_rows.where("label <> main").select(
        "unit",
        "sid",
        "label",
        F.pmod(F.xxhash64("sid", F.lit(1)), slots).alias("_slot"),
        F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("_block"),
    )
    used = asking.select("unit", "_slot", "_block").distinct()
    asking = asking.select("unit", (F.col("_slot") * 1_000_000 + F.col("_block")).alias("part"), "sid", "label")
    members = (
        open_rows.select("unit", F.col("part").alias("_block"), "sid", "label")
        .join(used, ["unit", "_block"])
        .select("unit", (F.col("_slot") * 1_000_000 + F.col("_block")).alias("part"), "sid", "label")
    )
    more = materialise(_units(asking, members, sets, percent), "other-links")
    labels = components(links.unionByName(more))

    grouped = table.where("n > 0").groupBy("sid").agg(F.min("id").alias("least"))
    grouped = grouped.join(labels, grouped["sid"] == labels["node"], "left").select(
        F.col("sid").alias("_sid"), "least", F.coalesce("label", "sid").alias("_label")
    )
    grouped = materialise(grouped, "grouped-sets")
    lowest = grouped.groupBy(F.col("_label").alias("_l")).agg(F.min("least").alias("component_id"))
    members = materialise(grouped.join(lowest, F.col("_label") == F.col("_l")).select("_sid", "component_id"), "members")
    return table.join(members, F.col("sid") == F.col("_sid"), "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )


def keep_one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT
) -> DataFrame:
    """One row of every component of ``join_by_shingles``, that with the smallest id; all columns stay.

    Of rows that share a kept id one stays, the first by text. Rows without shingles or without id are linked with
    nothing and stay.
    """
    joined = join_by_shingles(docs, id_col, text_col, width, percent)
    kept = joined.where((F.col("n_shingles") == 0) | (F.col("component_id") == F.col(id_col)))
    same, least, at = unused(docs.columns, "_kept", "_least", "_place")
    kept = kept.groupBy(F.col(id_col).alias(same)).agg(F.min("n_shingles").alias(least))
    rows = docs.join(materialise(kept, "kept-documents"), docs[id_col].cast("long") == F.col(same))
    place = F.row_number().over(Window.partitionBy(same).orderBy(F.xxhash64(text_col), text_col))
    one = rows.withColumn(at, place).where((F.col(at) == 1) | (F.col(least) == 0))
    return one.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
