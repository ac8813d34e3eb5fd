"""Reports kept up to date from change feeds, without a second scan of the facts.

A report's state holds sums per key. A change feed brings rows of the fact table with a ``sign``:
+1 for a row as it is after the change, -1 for one as it was before; an update brings both.
Sums of the feed are added to the state, which is all that is read beside the feed. A key that
no row is left for goes. Rows that a cascade deletes are the ones the delete job drops anyway:
it hands them on with sign -1; where the deleted parent is the state's own key, ``without_keys``
drops it. Every measure is a sum, so feeds can be applied in any order and size, and a state
after all feeds equals the state of the facts as they are then.
"""

from pyspark.sql import DataFrame, functions as F

from tillworks.functions.columns import line_total
from tillworks.operators.changes import delete_children
from tillworks.schemas import MONEY_SUM


def _flag(condition):
    """1 where the condition holds, else 0, NULL included."""
    return F.when(condition, 1).otherwise(0).cast("bigint")


def rating_measures() -> dict:
    """Per product_id, over approved reviews (see ``reports.product_ratings``)."""
    rating = F.col("rating")
    return {"rows": F.lit(1).cast("bigint"), "rated": _flag(rating.isNotNull()),
            "stars": F.coalesce(rating.cast("bigint"), F.lit(0)), "five_star": _flag(rating >= 4),
            "three_star": _flag(rating == 3), "low_rating": _flag(rating <= 2)}


def item_measures() -> dict:
    """Per order_id, over order items (see ``reports.order_totals`` and ``order_summary``)."""
    units = F.col("quantity").cast("bigint")
    worth = F.coalesce(line_total("quantity", "price_at_time"), F.lit(0)).cast(MONEY_SUM)
    return {"rows": F.lit(1).cast("bigint"), "counted": _flag(units.isNotNull()),
            "units": F.coalesce(units, F.lit(0)), "total": worth}


def _summed(rows: DataFrame, key: str, names, kinds=None) -> DataFrame:
    sums = [F.sum(n).cast((kinds or rows.schema)[n].dataType).alias(n) for n in names]
    return rows.groupBy(key).agg(*sums).where("rows <> 0")


def state_of(facts: DataFrame, key: str, measures: dict) -> DataFrame:
    """The state of a whole fact table, made once."""
    rows = facts.select(key, *[m.alias(n) for n, m in measures.items()])
    return _summed(rows, key, measures)


def refreshed(state: DataFrame, feed: DataFrame, key: str, measures: dict) -> DataFrame:
    """The state after a feed of signed fact rows; the feed is summed before it meets it."""
    signed = feed.select(key, *[(m * F.col("sign")).cast(state.schema[n].dataType).alias(n)
                                for n, m in measures.items()])
    change = signed.groupBy(key).agg(*[F.sum(n).cast(state.schema[n].dataType).alias(n)
                                       for n in measures])
    return _summed(state.unionByName(change), key, measures, state.schema)


def signed(rows: DataFrame, sign: int) -> DataFrame:
    return rows.withColumn("sign", F.lit(sign))


def replaced(before: DataFrame, after: DataFrame) -> DataFrame:
    """The feed of an update, from the changed rows as they were and as they are."""
    return signed(before, -1).unionByName(signed(after, 1))


def without_keys(state: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The state once the parents in ``gone`` (unique ids) are deleted with all their facts."""
    return delete_children(state, key, gone)


def approved(reviews: DataFrame) -> DataFrame:
    return reviews.where("is_approved")


def product_ratings(products: DataFrame, state: DataFrame) -> DataFrame:
    """``reports.product_ratings`` from the state of the approved reviews."""
    counts = {"review_count": "rows", "five_star": "five_star", "three_star": "three_star",
              "low_rating": "low_rating"}
    nothing = F.lit(0).cast("bigint")
    mean = F.col("stars").cast("double") / F.when(F.col("rated") > 0, F.col("rated"))
    return products.select("id", "name", "slug").join(
        state.withColumnRenamed("product_id", "id"), "id", "left").select(
        "id", "name", "slug", F.coalesce(mean, F.lit(0.0)).alias("avg_rating"),
        *[F.coalesce(c, nothing).alias(n) for n, c in counts.items()])


def order_totals(orders: DataFrame, state: DataFrame) -> DataFrame:
    """``reports.order_totals`` from the state of the order items."""
    return orders.select("id").join(state.select(F.col("order_id").alias("id"), "total"), "id",
                                    "left").select(
        "id", F.coalesce("total", F.lit(0)).cast(MONEY_SUM).alias("order_total"))


def order_summary(orders: DataFrame, users: DataFrame, state: DataFrame) -> DataFrame:
    """``reports.order_summary`` from the state of the order items."""
    counts = state.select(F.col("order_id").alias("id"), F.col("rows").alias("item_count"),
                          F.when(F.col("counted") > 0, F.col("units")).alias("total_items"))
    people = users.select(F.col("id").alias("user_id"), "username", "email")
    header = ["id", "order_number", "total_amount", "status", "payment_status", "order_date"]
    return orders.select(*header, "user_id").join(counts, "id", "left").join(
        people, "user_id", "left").select(
        *header, "username", "email",
        F.coalesce("item_count", F.lit(0).cast("bigint")).alias("item_count"), "total_items")
