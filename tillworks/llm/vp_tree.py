"""Nearest neighbours by inner product with vantage-point trees per shard.

Inner products become angles by one more component: with M the largest norm, a vector x is
extended by sqrt(M^2 - |x|^2) and a query by 0, so cos(q', x') = q.x / (|q| M) and the nearest
is the one with the largest product. As one long vector would press all others together at
one pole, every power of two of the norm gets a tree of its own, longest first, and a query
whose k-th score no vector of that norm can reach leaves the tree out. A node splits its
vectors at the median angle from a vantage point and keeps the range of angles on each side.
With t the angle of the query's current k-th score and d its angle from the vantage point, a
side can hold something nearer only if d lies within t of its range (triangle inequality); it
is searched if d lies within FACTOR * t. Factor 1 is exact search on any vectors. Smaller
factors search less, but may miss most neighbours where a query is far from all vectors. The
k-th score of a query's first shard is shared with the others (`vector_units`). Scores are
computed on the original vectors.

Vectors that are null or empty, zero, hold null or non-finite components, or have a null id
take no part. Vectors of different lengths are not compared. Rows with a query's id count as
its own; repeated candidate rows are all candidates; a query with fewer than k candidates
gets those found; a pair whose product is not a number is left out. An empty table gives an empty table; other columns are ignored.
"""

import functools

import numpy as np

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.llm.vector_units import LEAF, Best, search_all, usable

FACTOR = 1.0

LEAST_NORM = 2.0**-40  # of the largest component; all shorter vectors share one tree


class _Node:
    __slots__ = ("vantage", "median", "rows", "inner", "outer", "low", "high")


def angle(cosines):
    return np.arccos(np.clip(cosines, -1, 1))


def build(points, rows, rng):
    """A tree over points[rows]; vectors that no vantage point separates share a leaf.

    ``low`` and ``high`` of a side are its range of angles from the vantage point above it.
    """
    node = _Node()
    node.rows, node.inner, node.outer = rows, None, None
    if len(rows) > LEAF:
        # of a few vantage points the one whose angles spread most
        tried = [(angle(points[rows] @ points[v]), v) for v in rng.choice(rows, 4)]
        away, node.vantage = max(tried, key=lambda x: x[0].std())
        node.median = float(np.median(away))
        near = away <= node.median
        if near.any() and not near.all():
            node.rows = None
            node.inner = build(points, rows[near], rng)
            node.outer = build(points, rows[~near], rng)
            for side, of in ((node.inner, away[near]), (node.outer, away[~near])):
                side.low, side.high = of.min(), of.max()
    return node


def search(ids, vectors, query_ids, queries, k, floor, factor):
    # norms are those of multiples within 1, whose squares do not overflow
    size, asked = np.abs(vectors).max(), np.abs(queries).max(axis=1, keepdims=True)
    scaled, turned = vectors / size, queries / asked
    norms = np.maximum(np.sqrt((scaled**2).sum(axis=1)), LEAST_NORM)
    lengths = np.sqrt((turned**2).sum(axis=1))
    turned /= lengths[:, None]
    best = Best(len(queries), k, floor, np.float64)
    # a cosine is right to some roundings per component, an angle to the root of them
    slack = 4 * np.sqrt((vectors.shape[1] + 2) * np.finfo(np.float64).eps)
    large, little = np.maximum(size, asked[:, 0]), np.minimum(size, asked[:, 0])

    def bar(rows):
        """The k-th score so far, of the directions of the queries and the scaled vectors."""
        score = np.minimum(best.bar(rows), np.finfo(np.float64).max)
        return score / large[rows] / little[rows] / lengths[rows]

    def reach(rows, top):
        """The angle of the k-th score, times the factor."""
        least = bar(rows)
        return np.where(np.isneginf(least), np.inf, factor * angle(least / top) + slack)

    def visit(node, rows, points, top):
        if node.inner is None:
            scores = np.einsum("qd,vd->qv", queries[rows], vectors[node.rows])
            best.offer(rows, scores, ids[node.rows], query_ids[rows])
            return
        away = angle(turned[rows] @ points[node.vantage, :-1])
        inside = away <= node.median
        for side, now in ((node.inner, inside), (node.outer, True), (node.inner, ~inside)):
            gap = np.maximum(side.low - away, away - side.high)
            fits = now & (gap <= reach(rows, top))
            if fits.any():
                visit(side, rows[fits], points, top)

    # below the largest, so that vectors of one length up to rounding share a tree
    bands, rng = np.frexp(norms / norms.max() * 0.999)[1], np.random.default_rng(8)
    for band in np.unique(bands)[::-1]:
        members = np.flatnonzero(bands == band)
        top = norms[members].max()
        rows = np.flatnonzero(bar(np.arange(len(queries))) <= top * (1 + slack))
        if len(rows):
            part = scaled[members] / top
            points = np.zeros((len(vectors), vectors.shape[1] + 1))
            points[members] = np.concatenate([part, np.sqrt(np.maximum(
                1 - (part**2).sum(axis=1), 0))[:, None]], axis=1)
            visit(build(points, members, rng), rows, points, top)
    return best


def nearest(vectors: DataFrame, every=20, k=20, factor=FACTOR, id_col="vec_id",
            vec_col="embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the nearest k found of each queried row."""
    chosen = usable(vectors, id_col, vec_col).where(F.exists("vec", lambda x: x != 0))
    return search_all(chosen, every, k, functools.partial(search, factor=factor), "double")
