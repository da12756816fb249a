"""Merkle manifest of a dataset: a leaf per row, a tree per group, a tree over the groups, and every row's proof."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType

from steepgrid.operators.ranks import number_rows
from steepgrid.session import materialise

FANOUT = 16
BLOCK_LEVELS = 3  # levels that one task hashes for a block of neighbouring rows: 16 ** 3 leaves
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
OUT_ROWS = 256  # rows of a batch that leaves a task; each carries a path of some kilobytes

STEP = "struct<left:string,right:string>"
PATH = f"array<{STEP}>"
_STEP = pa.struct([("left", pa.string()), ("right", pa.string())])


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Digest of a row: every field as ``-`` if null, else its UTF-8 byte count, a colon and its text."""

    def encoded(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[encoded(f) for f in fields]), 256)


def joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def _parents(digests: list[str]) -> list[str]:
    return [
        sha256("".join(digests[i : i + FANOUT]).encode()).hexdigest() for i in range(0, len(digests), FANOUT)
    ]


def hashed_levels(leaves: list[str], size: int, most: int) -> list[list[str]]:
    """All levels of one block, leaves first, of a tree with ``size`` leaves.

    A block of a larger tree goes up ``most`` levels, even one with few leaves; a tree that fits
    into one block goes up until one node remains.
    """
    levels = [leaves]
    while len(levels) <= most and (size > FANOUT**most or len(levels[-1]) > 1):
        levels.append(_parents(levels[-1]))
    return levels


def _runs(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[list[tuple]]:
    """Rows of one (group, block) after the other; blocks of a task come whole and in order."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("group", "block", *columns)), strict=True):
            if held and held[0][:2] != row[:2]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _block_roots(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "size", "leaf"):
            group, block, size, _ = rows[0]
            root = hashed_levels([r[3] for r in rows], size, most)[-1][0]
            yield pa.RecordBatch.from_arrays(
                [pa.array([group], pa.string()), pa.array([block]), pa.array([size]), pa.array([root])],
                ["group", "block", "size", "digest"],
            )

    return run


def _siblings(level: list[str]) -> tuple[list[str], list[str]]:
    """What stands left and right of every node in its run, as joined digests."""
    left, right = [], []
    for start in range(0, len(level), FANOUT):
        run = level[start : start + FANOUT]
        for i in range(len(run)):
            left.append("".join(run[:i]))
            right.append("".join(run[i + 1 :]))
    return left, right


def _fold(node: str, steps: list[tuple[str, str]]) -> str:
    for left, right in steps:
        node = sha256((left + node + right).encode()).hexdigest()
    return node


def _prover(id_type: pa.DataType, most: int, with_observed: bool, with_paths: bool):
    """Every row of a block with its proof: siblings inside the block, then those that the block's header row brings."""

    def columns(rows: list[tuple], first: int, pools: list[tuple[list, list]], upper: list[dict], header: tuple) -> dict:
        above = [(s["left"], s["right"]) for s in upper]
        paths = [
            [(left[i // FANOUT**k], right[i // FANOUT**k]) for k, (left, right) in enumerate(pools)] + above
            for i in range(first, first + len(rows))
        ]
        out = {
            "id": pa.array([r[3] for r in rows], id_type),
            "group": pa.array([header[0]] * len(rows), pa.string()),
            "leaf": pa.array([r[4] for r in rows], pa.string()),
            "subroot": pa.array([header[7]] * len(rows), pa.string()),
            "root": pa.array([header[8]] * len(rows), pa.string()),
            "proof": pa.array([sha256("".join(s for step in p for s in step).encode()).hexdigest() for p in paths], pa.string()),
        }
        if with_observed:
            out["observed"] = pa.array([r[5] for r in rows], pa.string())
            out["folded"] = pa.array([_fold(r[5], p) for r, p in zip(rows, paths, strict=True)], pa.string())
        if with_paths:
            sides = [pa.array([step[k] for p in paths for step in p], pa.string()) for k in (0, 1)]
            ends = pa.array(np.cumsum([0] + [len(p) for p in paths]).astype(np.int32))
            out["path"] = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(sides, fields=list(_STEP)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "size", "id", "leaf", "observed", "path", "subroot", "root"):
            header, rows = rows[0], rows[1:]
            pools = [_siblings(level) for level in hashed_levels([r[4] for r in rows], header[2], most)[:-1]]
            for first in range(0, len(rows), OUT_ROWS):
                yield pa.RecordBatch.from_pydict(columns(rows[first : first + OUT_ROWS], first, pools, header[6], header))

    return run


def butterfly(nodes: DataFrame, rounds: int) -> DataFrame:
    """Upper proofs of every node of many trees, without a pass downward.

    ``nodes`` has ``tree, place, size, digest``: the ``size`` nodes of a tree at places from 0. Before round r a node
    knows the root of its aligned subtree of 16 ** r nodes. In round r the subtrees of one parent swap these roots:
    each node sends its subtree's to the nodes at its own offset in the other 15 (an incomplete subtree's nodes stand
    in for the missing offsets, in turn), and every receiver hashes the parent for itself and keeps the siblings.
    After the last round all nodes of a tree hold its root and their own path. A tree that is done sends to itself.

    Returns ``tree, place, size, digest`` (now the tree's root) and ``path``. A round is one shuffle of
    16 rows a node; nothing is gathered beyond one parent's 16 digests.
    """
    state = nodes.select("tree", "place", "size", "digest", F.array().cast(PATH).alias("path"))
    for r in range(rounds):
        span = FANOUT**r
        place, size = F.col("place"), F.col("size")
        lane, base = place % span, place - place % (span * FANOUT)
        members = F.least(F.lit(span), size - (place - lane))
        lanes = F.sequence(lane, F.lit(span - 1).cast("long"), members.cast("long"))
        digits = F.sequence(F.lit(0).cast("long"), F.lit(FANOUT - 1).cast("long"))
        targets = F.flatten(F.transform(digits, lambda d: F.transform(lanes, lambda q: base + d * span + q)))
        # inside its own subtree a node needs to tell nobody but itself
        foreign = F.filter(targets, lambda t: (t < size) & (F.floor(t / span) != F.floor(place / span)))
        told = F.when(size > span, F.concat(F.array(place), foreign)).otherwise(F.array(place))
        digit = F.floor(place / span) % FANOUT
        sent = state.select(
            "tree",
            F.explode(told).alias("to"),
            "size",
            F.struct(digit.alias("digit"), F.col("digest").alias("digest")).alias("note"),
            place.alias("from"),
            "path",
        )
        own = F.floor(F.col("place") / span) % FANOUT
        gathered = sent.groupBy("tree", F.col("to").alias("place")).agg(
            F.first("size").alias("size"),
            F.array_sort(F.collect_list("note")).alias("notes"),
            F.first(F.when(F.col("from") == F.col("to"), F.col("path")), ignorenulls=True).alias("path"),
        )
        beside = [
            joined(F.transform(F.filter("notes", keep), lambda n: n["digest"])).alias(side)
            for side, keep in (("left", lambda n: n["digit"] < own), ("right", lambda n: n["digit"] > own))
        ]
        parent = F.sha2(joined(F.transform("notes", lambda n: n["digest"])), 256)
        unfinished = F.col("size") > span
        state = gathered.select(
            "tree",
            "place",
            "size",
            F.when(unfinished, parent).otherwise(F.col("notes")[0]["digest"]).alias("digest"),
            F.when(unfinished, F.concat("path", F.array(F.struct(*beside)))).otherwise(F.col("path")).alias("path"),
        )
    return state


def _rounds(size: int) -> int:
    rounds = 0
    while FANOUT**rounds < size:
        rounds += 1
    return rounds


def build_manifest(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    id_col: str = "doc_id",
    group_col: str = "source",
    observed: Mapping[str, Column] | None = None,
    paths: bool = True,
    block_levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """Every row with its leaf digest, its proof and the roots of its group's tree and of the whole dataset.

    A leaf is ``leaf_digest`` of ``fields``. In a group, leaves ascend by id; while several nodes remain, every 16
    consecutive ones (the last run may hold fewer) become the digest of their joined digests. The groups' subroots,
    by group (null first, else bytewise), make the upper tree in the same way.

    Leaves are numbered in their group by range and prefix sums, so a hot group spreads over all tasks. Blocks of
    16 ** ``block_levels`` consecutive leaves are hashed by one task each; their roots meet in a ``butterfly``, then the
    groups' roots in a second one. A block's header row then brings the upper path to its leaves. Only digests are
    shuffled, twice, never texts and never paths.

    ``observed`` replaces fields by expressions over ``docs``: the row as found now. Its leaf comes back as ``observed``,
    and ``folded`` is the root that it leads to along the recorded path: the dataset's, if nothing changed.

    Returns ``id_col, group_col, leaf, subroot, root``, ``proof`` (digest of all siblings, level by level, left to
    right), ``observed`` and ``folded`` if asked for, and with ``paths`` the proof itself: ``path``, an array of what
    stands left and right of the node at every level, as joined digests (``fold``). Null ids come first and, like repeated ids,
    stand in the order of their leaves; repeated rows are leaves of their own; a null group is a group; an empty
    table has no rows; columns outside ``fields`` are ignored, whatever their names.
    """
    kind = docs.schema[id_col].dataType
    now = [(observed or {}).get(f, F.col(f)) for f in fields]
    found = leaf_digest(now) if observed else F.lit(None).cast("string")
    leaves = materialise(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(group_col).cast("string").alias("group"),
            leaf_digest([F.col(f) for f in fields]).alias("leaf"),
            found.alias("observed"),
        ),
        "merkle-leaves",
    )
    width = FANOUT**block_levels
    numbered = number_rows(leaves, ["group"], ["id", "leaf"], "place", "size")
    placed = materialise(
        numbered.withColumn("place", F.col("place") - 1).withColumn("block", F.expr(f"place div {width}")), "merkle-places"
    )
    dealt = placed.select("group", "block", "place", "size", "leaf").repartition("group", "block")
    blocks = materialise(
        dealt.sortWithinPartitions("group", "block", "place").mapInArrow(
            _block_roots(block_levels), "group string, block long, size long, digest string"
        ),
        "merkle-blocks",
    )
    largest = blocks.agg(F.max("size").alias("n")).first()["n"] or 0
    upper = materialise(
        butterfly(
            blocks.select(
                F.col("group").alias("tree"),
                F.col("block").alias("place"),
                F.ceil(F.col("size") / width).alias("size"),
                "digest",
            ),
            _rounds(-(-largest // width)),
        ),
        "merkle-upper",
    )
    groups = number_rows(
        upper.where(F.col("place") == 0).select(F.col("tree").alias("name"), F.col("digest").alias("subroot")),
        [],
        ["name"],
        "rank",
        "size",
    )
    groups = materialise(groups, "merkle-groups")
    count = groups.count()
    top = butterfly(
        groups.select(
            F.lit(0).alias("tree"), (F.col("rank") - 1).alias("place"), "size", F.col("subroot").alias("digest")
        ),
        _rounds(count),
    ).select((F.col("place") + 1).alias("at"), F.col("digest").alias("root"), F.col("path").alias("above"))
    tops = materialise(
        groups.join(top, groups["rank"] == top["at"]).select("name", "subroot", "root", "above"), "merkle-tops"
    )
    headers = (
        upper.join(tops, F.col("tree").eqNullSafe(F.col("name")))
        .join(
            blocks.select(F.col("group").alias("g"), F.col("block").alias("b"), F.col("size").alias("leaves")),
            F.col("tree").eqNullSafe(F.col("g")) & (F.col("place") == F.col("b")),
        )
        .select(
            F.col("tree").alias("group"),
            F.col("place").alias("block"),
            F.lit(-1).cast("long").alias("place"),  # before the block's leaves
            F.col("leaves").alias("size"),
            F.lit(None).cast(kind).alias("id"),
            F.lit(None).cast("string").alias("leaf"),
            F.lit(None).cast("string").alias("observed"),
            F.concat("path", "above").alias("path"),
            "subroot",
            "root",
        )
    )
    rows = placed.select(
        "group",
        "block",
        "place",
        "size",
        "id",
        "leaf",
        "observed",
        F.lit(None).cast(PATH).alias("path"),
        F.lit(None).cast("string").alias("subroot"),
        F.lit(None).cast("string").alias("root"),
    )
    texts = ["group", "leaf", "subroot", "root", "proof"] + (["observed", "folded"] if observed else [])
    schema = StructType([rows.schema["id"], *[StructField(name, StringType()) for name in texts]])
    if paths:
        schema = schema.add(rows.schema["path"])
    return (
        headers.unionByName(rows)
        .repartition("group", "block")
        .sortWithinPartitions("group", "block", "place")
        .mapInArrow(_prover(to_arrow_type(kind), block_levels, bool(observed), paths), schema)
        .withColumnsRenamed({"id": id_col, "group": group_col})
    )


def fold(leaf: Column, path: str = "path") -> Column:
    """The root that a leaf and the siblings of its path lead to."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))
