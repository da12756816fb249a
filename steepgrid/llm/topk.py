"""Exact top-k inner products by dual-tree search over cover trees of vector blocks."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from steepgrid.llm.cover_tree import FANOUT, Queries, Tree, build, queries_of, search
from steepgrid.llm.words import batched, rows_of
from steepgrid.session import materialise

TOP = 20
EVERY = 20  # rows whose id this divides are queries
BLOCK = 4096  # vectors of one cover tree
SAMPLE = 2048  # vectors that the centres dealing rows to blocks are chosen from
SCALE = 64
_OLD = np.iinfo(np.int64).max - 1

_BLOCKS = pa.schema(
    [
        ("block", pa.int64()),
        ("centre", pa.list_(pa.float64())),
        ("radius", pa.float64()),
        ("asks", pa.int64()),
        ("q_radius", pa.float64()),
        ("worst", pa.float64()),
        ("tree", pa.binary()),
        ("queries", pa.binary()),
    ]
)
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _matrix(vectors: list[list[int]]) -> np.ndarray:
    """Rows of equal length; a shorter vector ends in zeros. The smallest integer type that holds them."""
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), max(1, width)), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    top = np.abs(out).max(initial=0)
    return out.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)


def _deal(centres: np.ndarray):
    """The nearest centre of every vector."""
    schema = pa.schema([("id", pa.int64()), ("vector", pa.list_(pa.int64())), ("cell", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            if not vectors:
                continue
            rows = np.zeros((len(vectors), centres.shape[1]))
            for i, v in enumerate(vectors):
                rows[i, : len(v)] = v[: centres.shape[1]]
            cells = ((centres**2).sum(axis=1)[None, :] - 2 * rows @ centres.T).argmin(axis=1)
            yield pa.record_batch([batch.column("id"), batch.column("vector"), pa.array(cells, pa.int32())], schema=schema)

    return run


def _index(k: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(rows_of(batches, "id", "vector"))
        if not rows:
            return
        ids = np.array([r[0] for r in rows], np.int64)
        tree = build(_matrix([r[1] for r in rows]), ids)
        queries = queries_of(tree, tree.ids % every == 0, k)
        search(queries, tree)
        row = (
            TaskContext.get().partitionId(),
            tree.centres[0].tolist(),
            float(tree.radii[0]),
            len(queries.ids),
            float(queries.radii[0]),
            queries.worst(),
            pickle.dumps(tree),
            pickle.dumps(queries) if len(queries.ids) else None,
        )
        yield from batched(iter([row]), _BLOCKS)

    return run


def _answers(q: Queries) -> Iterator[tuple]:
    for key, scores, found in zip(q.ids.tolist(), q.scores, q.found, strict=True):
        for score, name in zip(scores, found.tolist(), strict=True):
            if np.isfinite(score):
                yield key, name, int(score)


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from batched((x for (q,) in rows_of(batches, "queries") for x in _answers(pickle.loads(q))), _FOUND)


def _same_width(q: Queries, tree: Tree) -> None:
    width = max(q.rows.shape[1], tree.rows.shape[1])
    for side in (q, tree):
        more = ((0, 0), (0, width - side.rows.shape[1]))
        side.rows, side.centres = np.pad(side.rows, more), np.pad(side.centres, more)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for held, asked in rows_of(batches, "tree", "queries"):
            q, tree = pickle.loads(asked), pickle.loads(held)
            _same_width(q, tree)
            q.found[np.isfinite(q.scores)] = _OLD  # those found before are merged from their own block
            search(q, tree)
            for i in np.flatnonzero((q.found < _OLD).any(axis=1)):
                for score, name in zip(q.scores[i], q.found[i].tolist(), strict=True):
                    if name < _OLD:
                        yield int(q.ids[i]), name, int(score)

    yield from batched(rows(), _FOUND)


def _far_apart(sample: np.ndarray, count: int) -> np.ndarray:
    """Centres chosen farthest first, as the top of a cover tree."""
    points = sample.astype(np.float64)
    chosen = [0]
    nearest = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(points)) and nearest.max() > 0:
        chosen.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


def top_products(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = TOP,
    every: int = EVERY,
    scale: int = SCALE,
    block: int = BLOCK,
) -> DataFrame:
    """The ``k`` highest inner products of every query with all other rows, exactly.

    A component x becomes floor(scale * x). Rows whose id is divisible by ``every`` are the queries. Rows are dealt to
    the nearest of a few centres (chosen from a bounded sample: they decide who shares a block, not what is found),
    and range-partitioned by (cell, id) into blocks of about ``block`` rows, so a crowd of equal vectors is cut
    by id. Each block becomes one cover tree over its queries and data together, searched for its own queries first.
    A block pair is searched only if its centres and radii allow a product not below the queries' least kth
    score; inside, pairs of nodes are pruned alike (``cover_tree.search``). Answers of all pairs are merged.

    Returns ``query_id, rank, vec_id, score``; ties go to the smaller id. Vectors that are null or hold null or
    non-finite components, and rows without id, take no part; a shorter vector counts as ending in zeros. A row with the
    query's id is no answer; other rows that repeat an id are answers of their own; a query repeated with the same
    vector is asked once, and with other vectors it gets the best of them. Fewer rows than ``k`` give shorter lists, an
    empty table none; other columns are ignored. Products must fit 64 bits.
    """
    spark = vectors.sparkSession
    component = F.col(vector_col)
    finite = F.forall(component, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & component.isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(component, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("vector"),
    )
    count = rows.count()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").collect()
    centres = _far_apart(_matrix([r["vector"] for r in sample]), 2 * FANOUT) if sample else np.zeros((1, 1))
    blocks = max(1, -(-count // block))
    found_types = "query_id long, vec_id long, score long"
    index = materialise(
        rows.mapInArrow(_deal(centres), "id long, vector array<long>, cell int")
        .repartitionByRange(blocks, "cell", "id")
        .mapInArrow(
            _index(k, every),
            "block long, centre array<double>, radius double, asks long, q_radius double, worst double, "
            "tree binary, queries binary",
        ),
        "cover-trees",
    )
    known = index.agg(F.coalesce(F.max("block"), F.lit(-1)).alias("last")).first()["last"]
    asking = index.where("asks > 0").select(
        F.col("block").alias("q_block"),
        F.col("centre").alias("q_centre"),
        "q_radius",
        "worst",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(known, 0)).cast("long"))).alias("block"),
    )
    dot = F.aggregate(F.zip_with("q_centre", "centre", lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)

    def norm(name: str):
        return F.sqrt(F.aggregate(name, F.lit(0.0), lambda s, x: s + x * x))

    bound = dot + F.col("q_radius") * norm("centre") + F.col("radius") * norm("q_centre") + F.col("q_radius") * F.col("radius")
    pairs = (
        asking.where("block <> q_block")
        .join(index.select("block", "centre", "radius"), "block")
        .where(bound + 1e-6 + F.abs(bound) * 1e-9 >= F.col("worst"))
        .select("q_block", "block")
    )
    pairs = materialise(pairs, "block-pairs")
    other = (
        pairs.join(index.select("block", "tree"), "block")
        .join(index.select(F.col("block").alias("q_block"), "queries"), "q_block")
        .select("tree", "queries")
        .repartition(max(1, blocks * 4))
        .mapInArrow(_across, found_types)
    )
    own = index.where("asks > 0").select("queries").mapInArrow(_own, found_types)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        own.unionByName(other)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
