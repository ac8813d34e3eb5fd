"""Plans and results under the conditions of a large cluster: no table small
enough to broadcast, and one key holding a third of all rows."""

import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from tillworks.operators import changes, inserts
from tillworks.plans import carts, catalog, checkout, fulfilment, reports, stock
from tillworks.sources.star import AS_OF, StarShop

FOLDER = "/root/testdata/sf0.01"
NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
SMALL_PARTITIONS = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
                    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
                    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
                    "spark.sql.adaptive.coalescePartitions.enabled": "false",
                    "spark.sql.shuffle.partitions": "32"}


@contextmanager
def settings(spark, **groups):
    values = {k: v for group in groups.values() for k, v in group.items()}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name in values:
            spark.conf.unset(name)


@pytest.fixture(scope="module")
def shop(spark):
    return StarShop(spark, FOLDER)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan(df)


def scans(df):
    return re.findall(r"ReadSchema: struct<(.*?)>", plan(df))


REPORTS = {
    "top": lambda s: reports.top_selling_products(s.products, s.order_items),
    "valid": lambda s: reports.top_selling_products_valid(s.products, s.order_items, s.orders),
    "summary": lambda s: reports.order_summary(s.orders, s.users, s.order_items),
    "totals": lambda s: reports.order_totals(s.orders, s.order_items),
    "ratings": lambda s: reports.product_ratings(s.products, s.reviews),
    "account": lambda s: carts.account_summary(s.users, s.cart_items, s.products, s.wishlist, s.orders),
    "listing": lambda s: catalog.catalog_listing(s.products, s.categories, s.reviews),
    "stock": lambda s: stock.stock_after_orders(s.products, s.new_order_items),
    "status": lambda s: fulfilment.apply_status_changes(s.orders, s.users, s.status_changes),
    "notices": lambda s: fulfilment.status_notifications(s.orders, s.users, s.status_changes),
    "items": lambda s: changes.cascade_delete(
        {"products": s.products, "product_variants": s.product_variants, "order_items": s.order_items},
        "products", s.deleted_products)["order_items"],
    "reviews": lambda s: inserts.insert_ignore(
        s.stored_reviews, s.review_feed, [["product_id", "user_id"]], "id",
        [("product_id", s.products, "id"), ("user_id", s.users, "id")]),
    "kpis": lambda s: catalog.admin_kpis(s.products, s.users, s.orders),
}


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_plans_need_no_broadcast_no_nested_loop_and_no_python(spark, shop, name):
    with settings(spark, a=NO_BROADCAST):
        text = plan(REPORTS[name](shop))
    for unwanted in ("BroadcastHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct",
                     "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert unwanted not in text


def test_scans_read_only_the_columns_used(shop):
    assert sorted(scans(REPORTS["top"](shop))) == sorted([
        "p_partkey:bigint,p_name:string,p_type:string,p_retailprice:double",
        "l_orderkey:bigint,l_partkey:bigint,l_quantity:double"])
    assert "l_linestatus" in plan(REPORTS["stock"](shop))
    assert "EqualTo(l_linestatus,O)" in plan(REPORTS["stock"](shop))
    monthly = plan(reports.monthly_sales_report(shop.orders, 1998, 10))
    assert "GreaterThanOrEqual(o_orderdate" in monthly and "LessThan(o_orderdate" in monthly
    low = plan(reports.low_stock_products(shop.products, 10))
    assert "p_brand" in low and "p_name" in low


def test_items_move_once_for_the_join_and_counts_once(spark, shop):
    with settings(spark, a=NO_BROADCAST):
        text = plan(reports.top_selling_products_valid(shop.products, shop.order_items, shop.orders))
    # items and orders by order, counts and products by product, and the final sort
    assert text.count("Exchange hashpartitioning") == 4
    assert text.count("Exchange rangepartitioning") == 1


def test_top_k_is_not_a_full_sort(spark, shop):
    people = shop.users.select(F.col("id").alias("user_id"), "username")
    text = plan(shop.orders.join(people, "user_id").orderBy(F.desc("order_date"), F.desc("id")).limit(8))
    assert "TakeOrderedAndProject" in text


def _skewed_orders(spark, n=30000):
    """A third of the orders belongs to one user and a third to nobody."""
    user = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.col("id") % 1500)
    return spark.range(0, n, 1, 8).select(
        "id", user.cast("bigint").alias("user_id"),
        F.concat(F.lit("ORD-"), F.col("id").cast("string"), F.repeat(F.lit("x"), 40)).alias("order_number"),
        F.lit(5).cast("decimal(10,2)").alias("total_amount"), F.lit("paid").alias("status"),
        F.lit("paid").alias("payment_status"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("order_date"))


def test_a_user_with_a_third_of_all_orders_is_split(spark, shop):
    orders = _skewed_orders(spark)
    items = spark.range(0, 60000, 1, 8).select(
        (F.col("id") % 30000).alias("order_id"), F.lit(2).alias("quantity"))
    with settings(spark, a=NO_BROADCAST, b=SMALL_PARTITIONS):
        summary = reports.order_summary(orders, shop.users, items)
        assert "SortMergeJoin(skew=true)" in final_plan(summary)
        assert summary.count() == 30000
        named = summary.groupBy("username").count().where("username LIKE '%0007'").first()
        assert named["count"] == 10000 + orders.where("id % 3 = 1 AND user_id = 7").count()
        assert summary.where("username IS NULL").count() == 10000
        assert summary.agg(F.sum("total_items")).first()[0] == 120000


def test_deleting_users_splits_the_orders_of_a_hot_user(spark, shop):
    orders = _skewed_orders(spark)
    gone = spark.range(5, 9).union(spark.range(7, 8))
    with settings(spark, a=NO_BROADCAST, b=SMALL_PARTITIONS):
        kept = changes.null_out(orders, "user_id", gone)
        assert "SortMergeJoin(skew=true)" in final_plan(kept)
        assert kept.count() == 30000
        assert kept.where("user_id BETWEEN 5 AND 8").count() == 0
        lost = orders.where("user_id BETWEEN 5 AND 8 OR user_id IS NULL").count()
        assert kept.where("user_id IS NULL").count() == lost
        left = changes.delete_children(orders, "user_id", changes._stored_keys(gone, "id"))
        assert "SortMergeJoin(skew=true)" in final_plan(left)
        assert left.count() == 30000 - lost + 10000


def test_paying_splits_a_cart_with_a_third_of_all_lines(spark, shop):
    cart = spark.range(0, 60000, 1, 8).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 1500).cast("bigint").alias("user_id"),
        (F.col("id") % 2000).alias("product_id"), F.lit(None).cast("bigint").alias("variant_id"),
        F.lit(1).alias("quantity"))
    requests = shop.users.select(
        F.col("id").alias("request_id"), F.col("id").alias("user_id"), F.lit("Card").alias("card_name"),
        F.lit(None).cast("string").alias("payment_method"), "address")
    with settings(spark, a=NO_BROADCAST, b=SMALL_PARTITIONS):
        orders, items, left = checkout.place_orders(cart, shop.products, requests, AS_OF)
        assert "SortMergeJoin(skew=true)" in final_plan(items)
        assert (orders.count(), items.count(), left.count()) == (1000, 60000, 0)
        assert items.agg(F.sum("total_price")).first()[0] == orders.agg(F.sum("subtotal")).first()[0]


def test_a_product_in_a_third_of_all_carts_is_split(spark, shop):
    cart = spark.range(0, 60000, 1, 8).select(
        "id", (F.col("id") % 5000).alias("user_id"),
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 2000).cast("bigint").alias("product_id"),
        F.lit(None).cast("bigint").alias("variant_id"), F.lit(1).alias("quantity"))
    with settings(spark, a=NO_BROADCAST, b=SMALL_PARTITIONS):
        lines = carts.cart_lines(cart, shop.products)
        assert "SortMergeJoin(skew=true)" in final_plan(lines)
        assert lines.count() == 60000
        quotes = checkout.checkout_quotes(cart, shop.products)
        assert quotes.count() == 5000


def test_a_hot_product_is_combined_before_the_shuffle(spark, shop):
    text = plan(reports.top_selling_products(shop.products, shop.order_items))
    # the distinct count runs over (product, order), so a hot product is spread by order
    assert re.search(r"hashpartitioning\(product_id#\d+L, order_id#\d+L", text)


def test_orders_per_product_are_counted_without_a_map_of_all_items(spark, shop):
    for name in ("top", "valid"):
        for group in ({}, NO_BROADCAST):
            with settings(spark, a=group):
                text = plan(REPORTS[name](shop))
            assert not re.search(r"HashAggregate\(keys=\[[^]]*order_id", text)
            assert re.search(r"Sort \[product_id#\d+L ASC NULLS FIRST, order_id#", text)


def test_orders_per_product_with_repeated_and_null_keys(spark):
    items = spark.createDataFrame(
        [(1, 7, 2), (1, 7, 3), (1, 8, None), (1, None, 4), (2, None, 5), (2, None, None), (None, 9, 6),
         (None, None, 1), (3, 8, None), (3, 8, None)] + [(4, 7, 1)] * 500,
        "product_id bigint, order_id bigint, quantity int")
    orders = spark.createDataFrame([(7, "paid"), (7, "paid"), (8, "cancelled"), (9, "paid"), (None, "paid")],
                                   "id bigint, status string")
    products = spark.range(1, 6).selectExpr("id", "'n' AS name", "'s' AS slug", "1.0 AS price",
                                            "'i' AS image_url")
    def rows(df):
        return [(r.id, r.total_sold, r.times_ordered) for r in df.collect()]

    assert rows(reports.top_selling_products(products, items)) == [
        (4, 500, 1), (1, 9, 2), (2, 5, 0), (3, 0, 1), (5, 0, 0)]
    assert rows(reports.top_selling_products_valid(products, items, orders)) == [
        (4, 500, 1), (1, 5, 1), (2, 0, 0), (3, 0, 0), (5, 0, 0)]


@pytest.mark.parametrize("partitions", ["1", "16"])
def test_results_do_not_depend_on_the_number_of_partitions(spark, shop, partitions):
    def results():
        orders, items, cart = checkout.place_orders(
            shop.cart_items, shop.products, shop.checkout_requests, AS_OF)
        out = [orders, items, cart, carts.cart_upsert(shop.cart_items, shop.cart_adds),
               REPORTS["summary"](shop), REPORTS["status"](shop)]
        return [sorted(map(str, df.collect())) for df in out]

    usual = results()
    with settings(spark, a={"spark.sql.shuffle.partitions": partitions}):
        assert results() == usual
