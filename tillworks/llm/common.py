"""Reading tables and moving Arrow batches, shared by the operators of this folder."""

import os
from pathlib import Path

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# rows in one Arrow batch: texts may be long, so few rows are in memory at once
ROWS_PER_BATCH = 256
BITS = 1 << 23


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = ROWS_PER_BATCH) -> None:
    """Let Python workers receive few rows at a time and find this package.

    The folder of the package joins the workers' PYTHONPATH, for sessions started without
    it; where executors do not see that folder, pass the package with --py-files.
    """
    environment = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, *paths]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_bytes(column) -> list:
    """The UTF-8 bytes of an Arrow string column, None for null."""
    return column.cast(pa.large_binary()).to_pylist()


def crc32_remainder(column, divisor: int):
    """crc32 of the column as text, modulo ``divisor``; a null column counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")),
                  F.lit(divisor))


def text_groups(texts: list, limit: int):
    """Cut a list into (first, last) ranges of about ``limit`` bytes, one text at least."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield first, i
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield first, len(texts)


def ranges_index(starts, lengths):
    """The positions start..start+length of every range, one range after the other."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - before,
                                                        lengths)


def schema_with(frame: DataFrame, **added) -> T.StructType:
    """The frame's schema with fields of the given types (by their SQL names) at its end."""
    kinds = {"bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
             "string": T.StringType(), "binary": T.BinaryType()}
    return T.StructType([*frame.schema.fields,
                         *(T.StructField(n, kinds[k]) for n, k in added.items())])


def among(rows: DataFrame, column: str, wanted: DataFrame, keep=True, also=None) -> DataFrame:
    """Rows whose value may be among the wanted ones (or surely is not), by a bit table.

    Rows that meet the condition ``also`` are kept in any case.

    The table has at most ``BITS`` bits, as words of 64, so its broadcast is bounded. An exact
    join of what it lets through must follow; it only keeps other rows out of the shuffle.
    """
    bit = f"pmod(xxhash64({column}, 7), {BITS}L)"
    table = wanted.selectExpr(f"{bit} as bit").groupBy(
        F.expr("bit div 64").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, int(bit % 64)))").alias("mask"))
    hit = rows.withColumn("word", F.expr(f"{bit} div 64")).join(
        F.broadcast(table), "word", "left").withColumn(
        "hit", F.expr(f"coalesce(mask & shiftleft(1L, int({bit} % 64)), 0L) != 0"))
    wish = "hit" if keep else "not hit"
    return hit.where(f"({also}) or {wish}" if also else wish).drop("word", "mask", "hit")
