"""Cover trees over a block of vectors that holds queries and data together, and the dual-tree search over two of them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEAF = 512  # rows of a node that is not cut further: one product of matrices costs less than many small ones
ASKED = 256  # queries of a node that are not cut further
FANOUT = 32
_MISSING = np.iinfo(np.int64).max


@dataclass
class Tree:
    """Nodes of a cover tree; a node's points are a slice of the rows in tree order."""

    rows: np.ndarray  # vectors in tree order
    ids: np.ndarray
    first: np.ndarray  # per node: slice of its rows
    last: np.ndarray
    centres: np.ndarray  # per node: vector
    radii: np.ndarray  # per node: largest distance of a row from the centre
    children: list[list[int]]


def build(vectors: np.ndarray, ids: np.ndarray) -> Tree:
    """Each node's rows go to centres chosen farthest first until all lie within half the node's radius of one.

    At most FANOUT centres are taken; radii are those measured, so bounds hold for any choice. Nodes with few rows, or
    with equal ones, are leaves.
    """
    points = vectors.astype(np.float64)
    order = np.arange(len(points))
    first, last, centres, radii, children = [], [], [], [], []

    def distances(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
        return np.sqrt(((points[rows] - centre) ** 2).sum(axis=1))

    def node(a: int, b: int, centre: np.ndarray, radius: float) -> int:
        first.append(a), last.append(b), centres.append(centre), radii.append(radius), children.append([])
        return len(first) - 1

    root = points.mean(axis=0).round()
    todo = [node(0, len(points), root, float(distances(order, root).max()))]
    while todo:
        here = todo.pop()
        a, b = first[here], last[here]
        if b - a <= LEAF or radii[here] == 0:
            continue
        rows = order[a:b].copy()
        nearest = distances(rows, centres[here])
        chosen = [int(np.argmin(nearest))]
        nearest = distances(rows, points[rows[chosen[0]]])
        owner = np.zeros(len(rows), np.int64)
        while nearest.max() > radii[here] / 2 and len(chosen) < FANOUT:
            far = int(np.argmax(nearest))
            d = distances(rows, points[rows[far]])
            closer = d < nearest
            owner[closer], nearest[closer] = len(chosen), d[closer]
            chosen.append(far)
        if len(chosen) == 1:
            continue
        by_owner = np.argsort(owner, kind="stable")
        order[a:b] = rows[by_owner]
        bounds = a + np.searchsorted(owner[by_owner], np.arange(len(chosen) + 1))
        for i, c in enumerate(chosen):
            child = node(int(bounds[i]), int(bounds[i + 1]), points[rows[c]], float(nearest[owner == i].max()))
            children[here].append(child)
            todo.append(child)
    return Tree(vectors[order], ids[order], np.array(first), np.array(last), np.array(centres), np.array(radii), children)


@dataclass
class Queries:
    """The part of a tree that holds queries: the same nodes, with the slices and radii of their queries."""

    rows: np.ndarray
    ids: np.ndarray
    first: np.ndarray
    last: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    children: list[list[int]]
    scores: np.ndarray  # best found so far, by falling score
    found: np.ndarray  # their ids

    def worst(self) -> float:
        """The least kth score: what a row must reach to matter to any query."""
        return float(self.scores[:, -1].min()) if len(self.ids) else np.inf


def queries_of(tree: Tree, asked: np.ndarray, k: int) -> Queries:
    """``asked`` marks rows in tree order; a row that repeats an earlier query is not asked again."""
    places = np.flatnonzero(asked)
    _, once = np.unique(np.column_stack([tree.ids[places], tree.rows[places]]), axis=0, return_index=True)
    places = places[np.sort(once)]
    first, last = np.searchsorted(places, tree.first), np.searchsorted(places, tree.last)
    rows = tree.rows[places].astype(np.float64)
    radii = np.array(
        [
            np.sqrt(((rows[a:b] - c) ** 2).sum(axis=1)).max() if b > a else 0.0
            for a, b, c in zip(first, last, tree.centres, strict=True)
        ]
    )
    children = [[c for c in some if last[c] > first[c]] for some in tree.children]
    empty = (len(places), k)
    return Queries(
        tree.rows[places], tree.ids[places], first, last, tree.centres, radii, children,
        np.full(empty, -np.inf), np.full(empty, _MISSING),
    )


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors, in floating point where that is exact."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 2.0**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.float64)
    if top < 2.0**53:
        return a.astype(np.float64) @ b.astype(np.float64).T
    return (a.astype(np.int64) @ b.astype(np.int64).T).astype(np.float64)


def search(q: Queries, tree: Tree) -> None:
    """Improve the queries' best lists by the rows of ``tree``; a query's own id is no answer to it.

    A pair of nodes can be skipped when the largest inner product that centres and radii allow is below
    the least kth score of the node's queries. Equal scores are not skipped, since a smaller id may win. Nodes of up to
    ``ASKED`` queries and ``LEAF`` rows meet as a whole; there each query is held against the node of rows on its own.
    """
    if not len(q.ids) or not len(tree.ids):
        return
    k = q.scores.shape[1]
    q_norms, d_norms = np.linalg.norm(q.centres, axis=1), np.linalg.norm(tree.centres, axis=1)
    rows = q.rows.astype(np.float64)
    norms = np.linalg.norm(rows, axis=1)

    def bounds(i, j):
        inner = q.centres[i] @ tree.centres[j].T
        return inner + q.radii[i] * d_norms[j] + tree.radii[j] * q_norms[i] + q.radii[i] * tree.radii[j]

    def hopeless(bound, worst):
        return bound + 1e-6 + 1e-9 * np.abs(bound) < worst

    todo = [(float(bounds(0, 0)), 0, 0)]
    while todo:
        bound, i, j = todo.pop()
        asked, held = slice(q.first[i], q.last[i]), slice(tree.first[j], tree.last[j])
        if asked.stop == asked.start or hopeless(bound, q.scores[asked, -1].min()):
            continue
        left = q.children[i] if asked.stop - asked.start > ASKED else []
        right = tree.children[j]
        if not left and not right:
            own = rows[asked] @ tree.centres[j] + norms[asked] * tree.radii[j]
            able = asked.start + np.flatnonzero(~hopeless(own, q.scores[asked, -1]))
            if len(able):
                _leaves(q, tree, able, held, k)
        elif right and (not left or tree.radii[j] >= q.radii[i]):
            values = bounds(i, np.array(right))
            todo += sorted(zip(values.tolist(), [i] * len(right), right), key=lambda x: x[0])
        else:
            todo += sorted(((float(bounds(c, j)), c, j) for c in left), key=lambda x: x[0])


def _best_columns(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best of each row and their ids, in no order; of equal scores those with the smaller ids."""
    by_id = np.argsort(ids, kind="stable")
    scores, ids = scores[:, by_id], ids[by_id]
    least = np.partition(scores, -k, axis=1)[:, -k, None]
    above, level = scores > least, scores == least
    spare = k - above.sum(axis=1, keepdims=True)
    places = np.nonzero(above | (level & (np.cumsum(level, axis=1) <= spare)))[1].reshape(-1, k)
    return np.take_along_axis(scores, places, axis=1), ids[places]


def _leaves(q: Queries, tree: Tree, asked: np.ndarray, held: slice, k: int) -> None:
    scores = exact_products(q.rows[asked], tree.rows[held])
    ids = tree.ids[held]
    scores[q.ids[asked][:, None] == ids[None, :]] = -np.inf
    best = scores.max(axis=1)
    better = (best >= q.scores[asked, -1]) & (best > -np.inf)
    if not better.any():
        return
    rows, scores = asked[better], scores[better]
    if len(ids) > k:
        scores, names = _best_columns(scores, ids, k)
    else:
        names = np.broadcast_to(ids, scores.shape)
    both = np.hstack([q.scores[rows], scores])
    names = np.hstack([q.found[rows], np.where(np.isfinite(scores), names, _MISSING)])
    order = np.lexsort((names, -both))[:, :k]
    q.scores[rows] = np.take_along_axis(both, order, axis=1)
    q.found[rows] = np.take_along_axis(names, order, axis=1)
