"""Exact top-k inner products by branch and bound over a ball tree per shard.

Each component is turned into floor(1024 x); scores are integer inner products. A
node's ball has a centre and a radius, and no vector in it can score more with a query than
query . centre + |query| radius. Children are visited in the order of this bound, and a
node whose bound is under the query's current k-th score is left out; equal bounds are
visited, so that ties go to the smaller id. The k-th score found in a query's first shard
is shared with all its other shards (`vector_units`).

Vectors that are null or empty, hold null or non-finite components or such as become infinite
times 1024, or have a null id take no part. Scores are exact at any size; a pair whose score
does not fit a signed 64-bit integer is left out. Vectors of different lengths are not compared. Rows with a query's id count as its
own and are no candidates; repeated candidate rows are all candidates; a query with fewer
than k candidates gets all of them. An empty table gives an empty table; other columns are
ignored.
"""

import numpy as np

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.llm.vector_units import LEAF, Best, search_all, usable

SCALE = 1024
_EXACT, _LONG = 2.0**53, 2.0**63


class _Node:
    __slots__ = ("centre", "radius", "rows", "children")


def build(points, rows):
    """A ball tree over points[rows]; equal points share a leaf of any size."""
    node = _Node()
    own = points[rows]
    node.centre = own.mean(axis=0)
    away = np.sqrt(((own - node.centre) ** 2).sum(axis=1))
    node.radius, node.rows, node.children = float(away.max()), rows, None
    if len(rows) > LEAF and node.radius > 0:
        one = own[away.argmax()]
        other = own[((own - one) ** 2).sum(axis=1).argmax()]
        side = own @ (one - other)
        left = side > np.median(side)
        if not left.any():
            left = side >= np.median(side)
        if left.any() and not left.all():
            node.rows = None
            node.children = (build(points, rows[left]), build(points, rows[~left]))
    return node


def _products(queries, points):
    """Integer inner products of matrices of whole numbers held as floats, and which fit a long."""
    reach = np.outer(np.abs(queries).max(axis=1, initial=0),
                     np.abs(points).max(axis=1, initial=0)) * points.shape[1]
    if reach.max(initial=0) < _EXACT:
        return np.rint(queries @ points.T).astype(np.int64), True
    large = reach >= _LONG
    rows, columns = large.any(axis=1), large.any(axis=0)
    # sums that stay within a long are made of longs; the few others of Python's integers
    whole = [np.where(np.abs(x) < _LONG, x, 0).astype(np.int64) for x in (queries, points)]
    products, fits = whole[0] @ whole[1].T, np.ones(large.shape, bool)
    if large.any():
        exact = _objects(queries[rows]) @ _objects(points[columns]).T
        held = np.abs(exact) < 2**63
        at = np.ix_(rows, columns)
        fits[at] = held
        products[at] = np.where(held, exact, 0).astype(np.int64)
    return products, fits


def _objects(x):
    return np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)


def search(ids, vectors, query_ids, queries, k, floor):
    points, queries = np.floor(SCALE * vectors), np.floor(SCALE * queries)
    best = Best(len(queries), k, floor, np.int64)
    norms = np.sqrt((queries**2).sum(axis=1))

    def bound(node, rows):
        reach = np.sqrt((node.centre**2).sum()) + node.radius
        # rounding is far below this slack
        most = (queries[rows] @ node.centre + norms[rows] * node.radius
                + 1e-9 * norms[rows] * reach + 1e-6)
        # squares of huge components overflow: no bound
        return np.where(np.isfinite(most), most, np.inf)

    def visit(node, rows):
        if node.children is None:
            scores, fits = _products(queries[rows], points[node.rows])
            best.offer(rows, scores, ids[node.rows], query_ids[rows], fits)
            return
        bounds = np.stack([bound(child, rows) for child in node.children])
        first = bounds[1] > bounds[0]
        for turn in (0, 1):
            for child in (0, 1):
                mine = first == (child != turn)
                own = rows[mine]
                own = own[bounds[child][mine] >= best.bar(own)]
                if len(own):
                    visit(node.children[child], own)

    with np.errstate(over="ignore", invalid="ignore"):
        visit(build(points, np.arange(len(points))), np.arange(len(queries)))
    return best


def top_k(vectors: DataFrame, every=100, k=10, id_col="vec_id", vec_col="embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: exact best k of each queried row."""
    scaled = F.forall("vec", lambda x: F.abs(x * F.lit(float(SCALE))) < float("inf"))
    return search_all(usable(vectors, id_col, vec_col).where(scaled), every, k, search, "bigint")
