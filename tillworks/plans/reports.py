"""Sales, rating, order and stock reports.

Facts are grouped by their key before any join, so joins run between tables with
one row per key and nothing fans out.
"""

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillworks.functions.columns import exact_avg, line_total, money_total
from tillworks.schemas import MONEY_SUM, PAYMENT_MADE_STATUSES, VOID_STATUSES
from tillworks.sources.tables import MONTH_COLUMN


def _count() -> Column:
    return F.count(F.lit(1))


def is_valid_order(status="status") -> Column:
    """Neither cancelled nor refunded; an unknown status is not valid."""
    return ~F.col(status).isin(*VOID_STATUSES)


def _sold_per_product(items: DataFrame) -> DataFrame:
    """Orders are counted at the first row of each pair of product and order.

    Nearly every row is a pair of its own, so a distinct count would hold all rows of a
    task in hash maps, one of them over a whole file split. Sorted rows take a third of
    the memory, lie in bounded shuffle partitions, and spill.
    """
    pair = Window.partitionBy("product_id", "order_id").orderBy("product_id")
    first = (F.row_number().over(pair) == 1) & F.col("order_id").isNotNull()
    return items.select("product_id", "quantity", first.alias("first")).groupBy(
        F.col("product_id").alias("id")).agg(
        F.sum("quantity").alias("total_sold"), F.count_if("first").alias("times_ordered"))


def _rank_products(products: DataFrame, sold: DataFrame) -> DataFrame:
    return (
        products.select("id", "name", "slug", "price", "image_url")
        .join(sold, "id", "left")
        .withColumns({c: F.coalesce(c, F.lit(0).cast("bigint"))
                      for c in ("total_sold", "times_ordered")})
        .orderBy(F.desc("total_sold"), "id")
    )


def top_selling_products(products: DataFrame, items: DataFrame) -> DataFrame:
    """Units and orders per product, best sellers first; unsold products show 0.

    Items of cancelled and refunded orders count too: in the shop's own report
    the order status cannot remove an item. See top_selling_products_valid.
    """
    return _rank_products(products, _sold_per_product(items))


def top_selling_products_valid(products: DataFrame, items: DataFrame, orders: DataFrame) -> DataFrame:
    """The same ranking over items of valid orders only.

    Items stay partitioned by order from the join through the distinct count, so
    only the per-product counts move again.
    """
    valid = orders.where(is_valid_order()).select(F.col("id").alias("order_id"))
    kept = items.join(valid, "order_id", "left_semi")
    return _rank_products(products, _sold_per_product(kept))


def product_ratings(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """Average and spread of approved ratings; the top bucket holds 4 and 5.

    A review without a rating counts as a review but in no bucket.
    """
    rating = F.col("rating")
    rated = reviews.where("is_approved").groupBy(F.col("product_id").alias("id")).agg(
        exact_avg("rating").alias("avg_rating"),
        _count().alias("review_count"),
        F.count_if(rating >= 4).alias("five_star"),
        F.count_if(rating == 3).alias("three_star"),
        F.count_if(rating <= 2).alias("low_rating"))
    counts = ["review_count", "five_star", "three_star", "low_rating"]
    return products.select("id", "name", "slug").join(rated, "id", "left").select(
        "id", "name", "slug",
        F.coalesce("avg_rating", F.lit(0.0)).alias("avg_rating"),
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts])


def raw_product_ratings(reviews: DataFrame) -> DataFrame:
    """Average and count over all reviews, approved or not, of reviewed products."""
    return reviews.groupBy("product_id").agg(
        exact_avg("rating").alias("avg_rating"), _count().alias("review_count"))


def order_summary(orders: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Order header with customer and item counts.

    An order without items has item_count 0 and total_items NULL.
    """
    per_order = items.groupBy(F.col("order_id").alias("id")).agg(
        _count().alias("item_count"), F.sum("quantity").alias("total_items"))
    people = users.select(F.col("id").alias("user_id"), "username", "email")
    header = orders.select("id", "user_id", "order_number", "total_amount", "status",
                           "payment_status", "order_date")
    return (
        header.join(per_order, "id", "left").join(people, "user_id", "left")
        .select("id", "order_number", "total_amount", "status", "payment_status",
                "order_date", "username", "email",
                F.coalesce("item_count", F.lit(0).cast("bigint")).alias("item_count"),
                "total_items")
    )


def low_stock_products(products: DataFrame, threshold: int) -> DataFrame:
    """Products with stock from 1 to the threshold, scarcest first."""
    stock = F.col("stock_quantity")
    return (products.where((stock <= threshold) & (stock > 0))
            .select("id", "name", "sku", "stock_quantity", "category_id")
            .orderBy("stock_quantity", "id"))


def monthly_sales_report(orders: DataFrame, year: int, month: int) -> DataFrame:
    """Valid orders of one month per day, newest day first; empty days are absent.

    The month is a half-open range on the bare column, which reaches the scan;
    orders stored by month are also pruned to the one folder. The id is the
    primary key, so rows are counted, not distinct ids.
    """
    first = date(year, month, 1)
    after = date(year + month // 12, month % 12 + 1, 1)
    moment = orders.schema["order_date"].dataType
    in_month = ((F.col("order_date") >= F.lit(str(first)).cast(moment))
                & (F.col("order_date") < F.lit(str(after)).cast(moment)))
    if MONTH_COLUMN in orders.columns:
        in_month &= F.col(MONTH_COLUMN) == f"{year:04d}-{month:02d}"
    return (
        orders.where(in_month & is_valid_order())
        .groupBy(F.to_date("order_date").alias("sale_date"))
        .agg(_count().alias("order_count"),
             money_total("total_amount").alias("total_sales"),
             money_total("tax_amount").alias("total_tax"),
             money_total("shipping_amount").alias("total_shipping"),
             exact_avg("total_amount").alias("avg_order_value"))
        .orderBy(F.desc("sale_date"))
    )


def order_totals(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Value of every order's items; 0.00 for an order without items."""
    totals = items.groupBy(F.col("order_id").alias("id")).agg(
        F.sum(line_total("quantity", "price_at_time")).alias("total"))
    return orders.select("id").join(totals, "id", "left").select(
        "id", F.coalesce("total", F.lit(0)).cast(MONEY_SUM).alias("order_total"))


def user_order_counts(users: DataFrame, orders: DataFrame) -> DataFrame:
    """Valid orders per user; 0 for users without any."""
    counts = (orders.where(is_valid_order() & F.col("user_id").isNotNull())
              .groupBy(F.col("user_id").alias("id")).agg(_count().alias("order_count")))
    return users.select("id").join(counts, "id", "left").select(
        "id", F.coalesce("order_count", F.lit(0).cast("bigint")).alias("order_count"))


def payments_made(orders: DataFrame) -> DataFrame:
    """Paid, shipped and completed orders per user."""
    return (orders.where(F.col("status").isin(*PAYMENT_MADE_STATUSES)
                         & F.col("user_id").isNotNull())
            .groupBy("user_id").agg(_count().alias("payments")))


def register_views(products, users, orders, items, reviews) -> None:
    """Publish the three standing reports as temporary views."""
    top_selling_products(products, items).createOrReplaceTempView("top_selling_products")
    product_ratings(products, reviews).createOrReplaceTempView("product_ratings")
    order_summary(orders, users, items).createOrReplaceTempView("order_summary")
