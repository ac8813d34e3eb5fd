"""Reading the shop's tables from Parquet, always under a declared schema."""

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from tillworks.schemas import ENUMS, GUEST_SESSIONS, NOT_NULL, RANGES, SCHEMAS


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    schema = SCHEMAS[name]
    return spark.read.schema(schema).parquet(f"{root}/{name}").select(*schema.names)


def read_guest_sessions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GUEST_SESSIONS).parquet(path)


def read_shop(spark: SparkSession, root: str) -> dict:
    """All ten tables by name; nothing is read until a report uses one."""
    return {name: read_table(spark, root, name) for name in SCHEMAS}


def seed_rows(spark: SparkSession, name: str, rows) -> DataFrame:
    """A table from literal rows given as dicts; absent columns are NULL."""
    schema = SCHEMAS[name]
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)


# ---- layout on disk: what the shop's indexes become ----
# Orders are split by month, so a monthly report reads one folder. Tables joined
# on the order id are bucketed on it when saved in a catalog, so reports over
# orders and their items need no shuffle of either.
MONTH_COLUMN = "order_month"
BUCKET_KEYS = {"orders": "id", "order_items": "order_id", "users": "id",
               "cart_items": "user_id", "wishlist": "user_id", "reviews": "product_id"}


def with_month(orders: DataFrame) -> DataFrame:
    return orders.withColumn(MONTH_COLUMN, F.date_format("order_date", "yyyy-MM"))


def _quality(name: str, columns) -> dict:
    """What to count of a table's rows: their number, NULLs where there should be none, and
    values outside their enumeration or range. Names are (kind, column)."""
    counts = {("rows", ""): F.count(F.lit(1))}
    for c in NOT_NULL.get(name, ()):
        counts["nulls", c] = F.count_if(F.col(c).isNull())
    for c, allowed in ENUMS.get(name, {}).items():
        counts["outside", c] = F.count_if(~F.col(c).isin(*allowed))
    for c, (low, high) in RANGES.get(name, {}).items():
        counts["outside", c] = F.count_if(~F.col(c).between(low, high))
    return {key: count for key, count in counts.items() if not key[1] or key[1] in columns}


def write_table(df: DataFrame, root: str, name: str) -> dict:
    """Write a table's files; orders go into one folder per month.

    Returns counts by (kind, column), made while the rows are written: ("rows", ""), ("nulls",
    column) and ("outside", column), as the integrity reports would find them afterwards.
    """
    counts, seen = _quality(name, df.columns), Observation()
    df = df.observe(seen, *[count.alias(f"{kind} {c}") for (kind, c), count in counts.items()])
    if name == "orders":
        # rows are gathered by month so that files stay few, and a month with many
        # rows is split over several tasks at run time
        (with_month(df).hint("rebalance", MONTH_COLUMN)
         .write.mode("overwrite").partitionBy(MONTH_COLUMN).parquet(f"{root}/{name}"))
    else:
        df.write.mode("overwrite").parquet(f"{root}/{name}")
    found = seen.get
    return {(kind, c): found[f"{kind} {c}"] for kind, c in counts}


def read_orders_by_month(spark: SparkSession, root: str) -> DataFrame:
    """Orders with their month folder as a column, which reports prune on."""
    schema = T.StructType(SCHEMAS["orders"].fields + [T.StructField(MONTH_COLUMN, T.StringType())])
    return spark.read.schema(schema).parquet(f"{root}/orders")


def month_folders(orders: DataFrame) -> list:
    """The months that orders read by ``read_orders_by_month`` have folders for, newest first.

    One name per month reaches the driver, from the names of the files; none is opened.
    """
    found = {part.partition("=")[2] for path in orders.inputFiles() for part in path.split("/")
             if part.startswith(f"{MONTH_COLUMN}=")}
    return sorted((m for m in found if not m.startswith("__")), reverse=True)


def save_bucketed(df: DataFrame, table: str, name: str, buckets: int, splits: int = 4) -> None:
    """Save a table in the catalog, bucketed on its join key.

    Rows are gathered by bucket first, so that there are few files; each bucket is
    split over several tasks by a hash of the whole row, so a hot key does not
    land in one of them.
    """
    key = BUCKET_KEYS[name]
    bucket = F.pmod(F.hash(key), F.lit(buckets))
    split = F.pmod(F.xxhash64(*df.columns), F.lit(splits))
    (df.repartition(buckets * splits, bucket, split)
     .write.mode("overwrite").format("parquet").bucketBy(buckets, key).saveAsTable(table))
