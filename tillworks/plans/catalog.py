"""Storefront listings and the administrator's lists."""

from pyspark.sql import DataFrame, functions as F

from tillworks.functions.columns import (NO_CATEGORY, NO_TRACKING, UNCATEGORIZED, day_label,
                                         discount_label, dollars, expiry_label, image_src,
                                         money, or_label, preview, slugify, stars,
                                         status_label)
from tillworks.plans.reports import raw_product_ratings
from tillworks.schemas import MONEY_SUM, REVENUE_STATUSES
from tillworks.sources.tables import MONTH_COLUMN, month_folders


def catalog_listing(products: DataFrame, categories: DataFrame, reviews: DataFrame,
                    category_id: int = 0) -> DataFrame:
    """Product cards; a category id above zero keeps that category only.

    Inactive products are listed too, and ratings count unapproved reviews, as
    on the shop's pages.
    """
    if category_id > 0:
        products = products.where(F.col("category_id") == category_id)
    names = categories.select(F.col("id").alias("category_id"),
                              F.col("name").alias("category_name"))
    ratings = raw_product_ratings(reviews).withColumnRenamed("product_id", "id")
    average = F.coalesce("avg_rating", F.lit(0.0))
    return (
        products.select("id", "name", "description", "price", "category_id",
                        "stock_quantity", "image_url")
        .join(names, "category_id", "left")
        .join(ratings, "id", "left")
        .select("id", "name",
                or_label("category_name", UNCATEGORIZED).alias("category"),
                image_src("image_url").alias("image"),
                (F.coalesce("stock_quantity", F.lit(0)) > 0).alias("in_stock"),
                average.alias("avg_rating"),
                stars(average).alias("stars"),
                F.coalesce("review_count", F.lit(0).cast("bigint")).alias("review_count"),
                preview("description").alias("blurb"),
                money("price").alias("price_label"))
    )


def category_product_counts(categories: DataFrame, products: DataFrame) -> DataFrame:
    """How many products each category lists; 0 for empty ones."""
    counts = (products.where(F.col("category_id").isNotNull())
              .groupBy(F.col("category_id").alias("id"))
              .agg(F.count(F.lit(1)).alias("product_count")))
    return categories.select("id", "name").join(counts, "id", "left").select(
        "id", "name", F.coalesce("product_count", F.lit(0).cast("bigint")).alias("product_count"))


def admin_products(products: DataFrame, categories: DataFrame) -> DataFrame:
    """All products with their category, newest id first."""
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("cat_name"))
    return (
        products.select("id", "name", "price", "stock_quantity", "category_id",
                        "is_featured", "is_active")
        .join(names, "category_id", "left")
        .select("id", "name", dollars("price").alias("price_label"),
                F.coalesce("stock_quantity", F.lit(0)).alias("stock"),
                or_label("cat_name", NO_CATEGORY).alias("category"),
                "is_featured", "is_active")
        .orderBy(F.desc("id"))
    )


def categories_sorted(categories: DataFrame) -> DataFrame:
    return categories.select("id", "name", "slug").orderBy("name", "id")


def customers_list(users: DataFrame) -> DataFrame:
    """Customers without administrators, newest first."""
    return (
        users.where(F.col("role") == "user")
        .orderBy(F.desc("created_at"), F.desc("id"))
        .select("id", "username", "email", "is_premium", "is_active",
                day_label("created_at").alias("joined"))
    )


def coupons_list(coupons: DataFrame) -> DataFrame:
    """Coupons with printable value, minimum and expiry, newest id first."""
    return coupons.orderBy(F.desc("id")).select(
        "id", "code", status_label("discount_type").alias("type_label"),
        discount_label("discount_type", "discount_value").alias("value_label"),
        dollars("min_order_amount").alias("min_order_label"),
        expiry_label("end_date").alias("expiry_label"))


def recent_orders(orders: DataFrame, users: DataFrame, n: int = 50) -> DataFrame:
    """The ``n`` newest orders that still have a user.

    The newest ``n`` are chosen among three narrow columns of all orders with a
    user; the other columns are fetched for those ``n`` only.
    """
    newest = [F.desc("order_date"), F.desc("id")]
    chosen = orders.select("id", "user_id", "order_date").join(
        users.select(F.col("id").alias("user_id")), "user_id", "left_semi").orderBy(
        *newest).limit(n).select("id", "user_id")
    shown = chosen.join(orders.drop("user_id"), "id").join(
        users.select(F.col("id").alias("user_id"), "username", "email"), "user_id")
    return shown.orderBy(*newest).select(
        "id", "order_number", "username", "email", "total_amount",
        dollars("total_amount").alias("total_label"), status_label("status").alias("status_label"),
        or_label("tracking_number", NO_TRACKING).alias("tracking"),
        day_label("order_date").alias("day"), "order_date")


def recent_orders_by_month(orders: DataFrame, users: DataFrame, n: int = 50) -> DataFrame:
    """``recent_orders`` from the newest month folders alone.

    ``orders`` is read with ``tables.read_orders_by_month``. Every order of a month is newer than
    all of the months before it, so once the newest months hold ``n`` orders with a user, no
    older folder is read. The number of months is doubled until then; the list of folders comes
    from the listing of the files. Orders without a date are the oldest and come with the last
    step.
    """
    months = month_folders(orders)
    taken = 1
    while taken < len(months):
        newest = orders.where(F.col(MONTH_COLUMN) >= months[taken - 1])
        held = newest.select(F.col("user_id")).join(
            users.select(F.col("id").alias("user_id")), "user_id", "left_semi")
        if held.limit(n).count() == n:
            return recent_orders(newest, users, n)
        taken *= 2
    return recent_orders(orders, users, n)


def order_status_labels(orders: DataFrame) -> DataFrame:
    """Printable status, day and tracking of every order."""
    return orders.select(
        "id", status_label("status").alias("status_label"), day_label("order_date").alias("day"),
        or_label("tracking_number", NO_TRACKING).alias("tracking"))


def product_slugs(products: DataFrame) -> DataFrame:
    return products.select("id", "name", slugify("name").alias("name_slug"))


def admin_kpis(products: DataFrame, users: DataFrame, orders: DataFrame) -> DataFrame:
    """One row of shop totals; each table is read once."""
    names = ["total_products", "total_users", "premium_users", "total_orders", "pending_orders"]
    customer = F.col("role") == "user"
    revenue = F.when(F.col("status").isin(*REVENUE_STATUSES), F.col("total_amount"))
    parts = [
        products.agg(F.count(F.lit(1)).alias("total_products")),
        users.agg(F.count_if(customer).alias("total_users"),
                  F.count_if(customer & F.col("is_premium")).alias("premium_users")),
        orders.agg(F.count(F.lit(1)).alias("total_orders"),
                   F.count_if(F.col("status") == "pending").alias("pending_orders"),
                   F.sum(revenue).alias("total_revenue")),
    ]
    # three one-row results stacked and summed, so that no join is needed
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(
        *[F.sum(c).alias(c) for c in names],
        F.coalesce(F.sum("total_revenue"), F.lit(0)).cast(MONEY_SUM).alias("total_revenue"))
