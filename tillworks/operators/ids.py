"""Surrogate keys without a single-task global window."""

from pyspark.sql import DataFrame, Window, functions as F

from tillworks.session import cut_lineage

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def assign_ids(df: DataFrame, order_cols, start: int = 1, id_col: str = "id") -> DataFrame:
    """Number the rows ``start, start+1, …`` in the order of ``order_cols``.

    The columns must order the rows totally. Rows are range-partitioned and
    sorted inside each partition; the numbered rows are materialised once, so a
    lost executor cannot change an id that was already read. Only one row per
    partition (its size) passes through the offset window.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(
        df.repartitionByRange(parts, *order_cols)
        .sortWithinPartitions(*order_cols)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    part = F.shiftright("_place", _ROW_BITS)
    row = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    # at most one row of two longs per partition, so the broadcast is bounded
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(id_col, F.col("_offset") + row + F.lit(start))
        .drop("_part", "_offset", "_place")
    )


def next_id(table: DataFrame, floor: int = 1, id_col: str = "id") -> int:
    """The id the next inserted row gets: one past the largest, at least ``floor``."""
    largest = table.agg(F.max(id_col)).first()[0]
    return floor if largest is None else max(floor, largest + 1)


# ---- counters that outlive deletions ----
# A table's counter is the id its next row gets. It is published with the tables of a batch, so
# the id of a deleted newest row is not given out again.
COUNTERS = "table_name string, next_id bigint"


def no_counters(spark) -> DataFrame:
    return spark.createDataFrame([], COUNTERS)


def first_free(counters: DataFrame, name: str, table: DataFrame, floor: int = 1,
               id_col: str = "id") -> int:
    """The next id of a table: its counter, but past every id it holds and at least ``floor``."""
    mark = counters.where(F.col("table_name") == name).agg(F.max("next_id")).first()[0]
    return max(mark or floor, next_id(table, floor, id_col))


def advance(counters: DataFrame, name: str, next_free: int) -> DataFrame:
    """Counters with one table's moved on; they never move back."""
    moved = counters.sparkSession.createDataFrame([(name, next_free)], COUNTERS)
    return counters.unionByName(moved).groupBy("table_name").agg(F.max("next_id").alias("next_id"))


def reserve(counters: DataFrame, name: str, table: DataFrame, rows: int, floor: int = 1):
    """A block of ids for one job: ``(first id, counters after it)``.

    Jobs that append to one table at the same time each reserve a block and publish the counters
    before they write; ids a job does not use stay unused.
    """
    first = first_free(counters, name, table, floor)
    return first, advance(counters, name, first + rows)
