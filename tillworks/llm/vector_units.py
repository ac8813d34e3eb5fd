"""Searching every query against every vector in bounded units, shared by the two searches.

Vectors are dealt into shards and queries into blocks, both of bounded size: vectors by a hash of
a number that every row is given once, so that rows repeating an id or a vector spread over
shards, queries by a hash of id and vector. A unit is one shard with one block. The first round searches each block in one shard. Its
k-th scores go to the second round, which searches all other shards and can prune from
the start. The best k of each query are then taken from the rows of all units.
"""

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillworks.llm.common import small_batches
from tillworks.session import cut_lineage

SHARD_VALUES = 1 << 18  # numbers in a shard: 4,096 vectors of 64 components
BLOCK_QUERIES = 2048
LEAF = 64


def usable(vectors: DataFrame, id_col, vec_col) -> DataFrame:
    """vec_id and vec (array<double>) of the vectors that take part.

    Null ids, null and empty vectors, and those with null or non-finite components do not.
    """
    vec = F.col(vec_col).cast("array<double>")
    return vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), vec.alias("vec")).where(
        F.col("vec_id").isNotNull() & (F.size("vec") > 0) & F.forall(
            "vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def matrix(column):
    """An Arrow list column of equal lengths as a float matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


class Best:
    """The best k (score, id) found for each query so far, in order."""

    def __init__(self, queries, k, floor, dtype):
        self.k, self.floor = k, floor  # floor: a score k candidates are known to reach
        self.least = np.iinfo(dtype).min if np.issubdtype(dtype, np.integer) else -np.inf
        self.scores = np.full((queries, k), self.least, dtype)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max, np.int64)

    def bar(self, rows):
        """A candidate below this score is of no use."""
        return np.maximum(self.scores[rows, -1], self.floor[rows])

    def offer(self, rows, scores, ids, own, fits=True):
        """Candidates (ids) with scores for each of the rows; ``own`` are the rows' ids.

        Pairs that do not ``fits`` are left out.
        """
        use = (scores >= self.bar(rows)[:, None]) & (ids[None, :] != own[:, None]) & fits
        some = use.any(axis=1)
        if not some.any():
            return
        rows, use = rows[some], use[some]
        scores = np.where(use, scores[some], self.least)
        all_scores = np.concatenate([self.scores[rows], scores], axis=1)
        all_ids = np.concatenate([self.ids[rows], np.where(use, ids[None, :],
                                                           np.iinfo(np.int64).max)], axis=1)
        order = np.argsort(all_ids, axis=1, kind="stable")
        by_id = np.take_along_axis(all_scores, order, 1)
        falling = -by_id if by_id.dtype.kind == "f" else ~by_id
        order = np.take_along_axis(order, np.argsort(falling, axis=1, kind="stable"), 1)
        order = order[:, :self.k]
        self.scores[rows] = np.take_along_axis(all_scores, order, 1)
        self.ids[rows] = np.take_along_axis(all_ids, order, 1)


def search_all(vectors: DataFrame, every: int, k: int, search, score_type: str) -> DataFrame:
    """query_id, rank, vec_id, score: the best k for each vector whose id ``every`` divides.

    ``search(ids, vectors, query_ids, queries, k, floor)`` gives a ``Best`` for one unit.
    Rows sharing a query's id count as the query's own; repeated query rows count once.
    """
    spark = vectors.sparkSession
    small_batches(spark, 1000)
    vectors = cut_lineage(vectors.withColumn("dim", F.size("vec")).withColumn(
        "row", F.monotonically_increasing_id()))
    size = vectors.agg(F.sum("dim").alias("values"),
                       F.count_if(F.col("vec_id") % every == 0).alias("queries")).first()
    shards = max(1, -(-(size["values"] or 0) // SHARD_VALUES))
    blocks = max(1, -(-size["queries"] // BLOCK_QUERIES))
    stored = vectors.withColumn("shard", F.expr(f"int(pmod(xxhash64(row, 1), {shards}))")).drop(
        "row")
    asked = vectors.where(F.col("vec_id") % every == 0).select(
        "vec_id", "vec", "dim").distinct().select(
        F.col("vec_id").alias("query_id"), F.col("vec").alias("asked"),
        F.col("dim").alias("q_dim"),
        F.expr(f"int(pmod(xxhash64(vec_id, vec, 2), {blocks}))").alias("q_block"),
        F.xxhash64("vec_id", "vec").alias("query"))
    kind = np.int64 if score_type == "bigint" else np.float64
    arrow = pa.int64() if score_type == "bigint" else pa.float64()
    names = ["query", "query_id", "vec_id", "score"]

    def unit(_, left, right):
        ids = left.column("vec_id").to_numpy()
        if not len(ids) or not right.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), arrow)],
                            names=names)
        query_ids = right.column("query_id").to_numpy()
        floor = right.column("floor").to_numpy(zero_copy_only=False).astype(kind)
        best = search(ids, matrix(left.column("vec")), query_ids, matrix(right.column("asked")), k,
                      floor)
        row, column = np.nonzero(best.ids != np.iinfo(np.int64).max)
        return pa.table([right.column("query").to_numpy()[row], query_ids[row],
                         best.ids[row, column], pa.array(best.scores[row, column], arrow)],
                        names=names)

    def round_of(queries, home):
        same = F.expr(f"block % {shards} = shard")
        left = stored.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
                                 ).where(same if home else ~same)
        same = F.expr(f"q_block % {shards} = q_shard")
        right = queries.withColumn("q_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
                                   ).where(same if home else ~same)
        return left.groupBy("dim", "shard", "block").cogroup(
            right.groupBy("q_dim", "q_shard", "q_block")).applyInArrow(
            unit, f"query bigint, query_id bigint, vec_id bigint, score {score_type}")

    lowest = F.lit(int(np.iinfo(np.int64).min) if score_type == "bigint" else float("-inf"))
    first = cut_lineage(round_of(asked.withColumn("floor", lowest.cast(score_type)), True))
    reached = first.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    floored = asked.join(reached, "query", "left").withColumn(
        "floor", F.when(F.col("n") == k, F.col("least")).otherwise(lowest).cast(score_type)).drop(
        "n", "least")
    found = first.unionByName(round_of(floored, False)) if shards > 1 else first
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
