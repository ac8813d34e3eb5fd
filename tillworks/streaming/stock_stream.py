"""The stock ledger as a stream of inserted order items.

The stream turns every item into movements (kind, id, taken) and appends them to a Parquet folder
through Spark's file sink. The sink's own log names the files of finished batches: readers of
the folder see these only, a batch run again after a lost driver or executor is not added
twice, and the log compacts itself. Movements are summed when they are read. They lie in one
folder per day of their batch, so that with a stock snapshot of the end of some day only later
days are read.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tillworks.plans.stock import apply_movements
from tillworks.schemas import SCHEMAS

MOVEMENT_SCHEMA = "kind string, id bigint, taken bigint, day date"
_ITEM_COLUMNS = ["product_id", "variant_id", "quantity"]


def movements(items: DataFrame) -> DataFrame:
    """What each item takes: of its product, and of its variant if it has one."""
    taken = F.col("quantity").cast("bigint").alias("taken")
    product = F.struct(F.lit("product").alias("kind"), F.col("product_id").alias("id"), taken)
    variant = F.struct(F.lit("variant").alias("kind"), F.col("variant_id").alias("id"), taken)
    return items.select(F.explode(F.array_compact(F.array(
        product, F.when(F.col("variant_id").isNotNull(), variant)))).alias("m")).select("m.*")


def start_stock_stream(spark: SparkSession, source: str, out: str, checkpoint: str,
                       available_now: bool = True, files_per_batch: int = 1000,
                       interval: str = "1 minute") -> StreamingQuery:
    """Follow the Parquet files of new order items in ``source``."""
    wanted = [f for f in SCHEMAS["order_items"].fields if f.name in _ITEM_COLUMNS]
    schema = type(SCHEMAS["order_items"])(wanted)
    items = (spark.readStream.schema(schema)
             .option("maxFilesPerTrigger", files_per_batch).parquet(source))
    # the batch's own moment, which a batch run again keeps
    dated = movements(items).withColumn("day", F.to_date(F.current_timestamp()))
    writer = (dated.writeStream.format("parquet").outputMode("append").partitionBy("day")
              .option("path", out).option("checkpointLocation", checkpoint))
    if available_now:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=interval)
    return writer.start()


def read_movements(spark: SparkSession, out: str, kind: str, after_day=None) -> DataFrame:
    """Movements of finished batches summed per id, of all days or of those after ``after_day``."""
    found = spark.read.schema(MOVEMENT_SCHEMA).parquet(out).where(F.col("kind") == kind)
    if after_day is not None:
        found = found.where(F.col("day") > F.lit(after_day).cast("date"))
    return found.groupBy("id").agg(F.sum("taken").alias("taken"))


def current_stock(spark: SparkSession, stocked: DataFrame, out: str, kind: str,
                  after_day=None, as_of=None) -> DataFrame:
    """Stock of products or variants: a snapshot, taken after ``after_day`` ended, less every
    movement since."""
    return apply_movements(stocked, read_movements(spark, out, kind, after_day), as_of)
