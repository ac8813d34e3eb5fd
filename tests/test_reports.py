from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.shop import by_id, money, small_shop, ts
from tillworks.operators.lookups import category_titles, lookup, registration_conflicts
from tillworks.plans import catalog, reports


@pytest.fixture(scope="module")
def t(spark):
    return small_shop(spark)


def test_top_selling_counts_cancelled_orders_and_unsold_products(t):
    rows = reports.top_selling_products(t["products"], t["order_items"]).collect()
    assert [(r.id, r.total_sold, r.times_ordered) for r in rows][:3] == [(1, 9, 3), (3, 5, 2), (2, 0, 0)]
    assert len(rows) == 9


def test_top_selling_valid_leaves_cancelled_and_unknown_status_out(t):
    rows = by_id(reports.top_selling_products_valid(t["products"], t["order_items"], t["orders"]))
    assert (rows[1].total_sold, rows[1].times_ordered) == (4, 2)
    assert (rows[3].total_sold, rows[3].times_ordered) == (5, 2)
    assert (rows[9].total_sold, rows[9].times_ordered) == (0, 0)


def test_product_ratings(t):
    rows = by_id(reports.product_ratings(t["products"], t["reviews"]))
    assert rows[1][3:] == (4.5, 3, 2, 0, 0)
    assert rows[3][3:] == (3.0, 1, 0, 1, 0)
    assert rows[4][3:] == (2.0, 1, 0, 0, 1)
    assert rows[2][3:] == (0.0, 0, 0, 0, 0)


def test_product_with_only_unrated_reviews(spark, t):
    unrated = t["reviews"].where("rating IS NULL")
    assert by_id(reports.product_ratings(t["products"], unrated))[1][3:] == (0.0, 1, 0, 0, 0)


def test_raw_ratings_count_unapproved_reviews(t):
    rows = by_id(reports.raw_product_ratings(t["reviews"]), "product_id")
    assert rows[3][1:] == (2.0, 2)
    assert set(rows) == {1, 3, 4}


def test_order_summary_edges(t):
    rows = by_id(reports.order_summary(t["orders"], t["users"], t["order_items"]))
    assert (rows[1000].username, rows[1000].item_count, rows[1000].total_items) == ("Ann", 3, 4)
    assert (rows[1002].username, rows[1002].email) == (None, None)
    assert (rows[1004].item_count, rows[1004].total_items) == (0, None)
    assert len(rows) == 6


@pytest.mark.parametrize("threshold, stocks", [(10, [5]), (12, [5, 12]), (0, [])])
def test_low_stock_is_sorted_and_leaves_zero_and_null_out(t, threshold, stocks):
    rows = reports.low_stock_products(t["products"], threshold).collect()
    assert [r.stock_quantity for r in rows] == stocks


def test_monthly_report(t):
    rows = reports.monthly_sales_report(t["orders"], 2024, 1).collect()
    assert [r.sale_date.day for r in rows] == [7, 6, 5]
    newest = rows[0]
    assert (newest.order_count, newest.total_sales, newest.total_tax) == (2, money("100.00"), money("2.20"))
    assert newest.avg_order_value == 50.0


def test_month_bounds_are_half_open(spark):
    days = ["2023-12-31 23:59:59.999999", "2024-01-01 00:00:00", "2024-01-31 23:59:59.999999",
            "2024-02-01 00:00:00", "2024-12-31 23:59:59", "2025-01-01 00:00:00"]
    orders = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "id bigint, d string").select(
        "id", F.col("d").cast("timestamp_ntz").alias("order_date"), F.lit("paid").alias("status"),
        *[F.lit(1).cast("decimal(10,2)").alias(c)
          for c in ("total_amount", "tax_amount", "shipping_amount")])

    def dates(year, month):
        return [r.sale_date for r in reports.monthly_sales_report(orders, year, month).collect()]

    assert dates(2024, 1) == [date(2024, 1, 31), date(2024, 1, 1)]
    assert dates(2024, 12) == [date(2024, 12, 31)]
    assert dates(2023, 12) == [date(2023, 12, 31)]


def test_order_totals(t):
    rows = by_id(reports.order_totals(t["orders"], t["order_items"]))
    assert rows[1000].order_total == Decimal("324.96")
    assert rows[1004].order_total == Decimal("0.00")


def test_user_counts_and_payments(t):
    counts = by_id(reports.user_order_counts(t["users"], t["orders"]))
    assert {i: r.order_count for i, r in counts.items()} == {100: 0, 101: 1, 102: 2}
    paid = by_id(reports.payments_made(t["orders"]), "user_id")
    assert {i: r.payments for i, r in paid.items()} == {101: 1}


def test_named_views(spark, t):
    reports.register_views(t["products"], t["users"], t["orders"], t["order_items"], t["reviews"])
    assert spark.table("top_selling_products").first().id == 1
    assert spark.table("product_ratings").count() == 9
    assert spark.table("order_summary").count() == 6


def test_catalog(t):
    rows = by_id(catalog.catalog_listing(t["products"], t["categories"], t["reviews"]))
    assert rows[1].blurb == "..." and rows[2].blurb == "x" * 80 + "..."
    assert (rows[9].category, rows[9].in_stock) == ("Uncategorized", False)
    assert rows[7].price_label == "1,299.99"
    assert (rows[1].stars, rows[1].review_count) == ("★★★★★", 3)
    assert rows[5].image == "b.jpg" and rows[3].image == "img/placeholder.jpg"
    assert set(by_id(catalog.catalog_listing(t["products"], t["categories"], t["reviews"], 2))) == {3, 8}
    assert catalog.catalog_listing(t["products"], t["categories"], t["reviews"], 99).count() == 0


def test_category_counts_titles_and_lists(spark, t):
    counts = by_id(catalog.category_product_counts(t["categories"], t["products"].where("id <> 4")))
    assert {i: r.product_count for i, r in counts.items()} == {1: 3, 2: 2, 3: 0, 4: 2}
    asked = spark.createDataFrame([(1,), (1,), (55,)], "category_id bigint")
    titles = by_id(category_titles(asked, t["categories"]), "category_id")
    assert {i: r.title for i, r in titles.items()} == {1: "Gadgets", 55: "All Products"}
    assert [r.id for r in catalog.categories_sorted(t["categories"]).collect()] == [1, 2, 4, 3]
    assert [r.id for r in catalog.customers_list(t["users"]).collect()] == [102, 101]
    assert [r.id for r in catalog.admin_products(t["products"], t["categories"]).collect()][:2] == [9, 8]
    coupons = catalog.coupons_list(t["coupons"]).collect()
    assert coupons[0][1:] == ("TWENTY", "Fixed", "$1,234.50", "$0.00", "No expiry")
    assert coupons[1][1:] == ("TEN", "Percentage", "10.00%", "$50.00", "Mar 05, 2024")


def test_kpis(t):
    row = catalog.admin_kpis(t["products"], t["users"], t["orders"]).collect()
    assert [tuple(r) for r in row] == [(9, 2, 1, 6, 1, money("100.00"))]
    none = catalog.admin_kpis(t["products"].limit(0), t["users"].limit(0), t["orders"].limit(0))
    assert [tuple(r) for r in none.collect()] == [(0, 0, 0, 0, 0, money("0.00"))]


def test_recent_orders(t):
    rows = catalog.recent_orders(t["orders"], t["users"], 3).collect()
    assert [r.id for r in rows] == [1005, 1004, 1003]
    assert (rows[0].tracking, rows[2].status_label) == ("Not assigned", "Delivered")
    everything = catalog.recent_orders(t["orders"], t["users"], 50).collect()
    assert [r.id for r in everything] == [1005, 1004, 1003, 1001, 1000]


@pytest.mark.parametrize("n", [99_999, 100_000, 100_001])
def test_recent_orders_has_no_limit_of_its_own(spark, t, n):
    orders = spark.range(300_000).select(
        "id", F.when(F.col("id") >= 250_000, F.col("id")).otherwise(F.lit(101)).alias("user_id"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in t["orders"].schema.fields
          if f.name not in ("id", "user_id")])
    ids = [r.id for r in catalog.recent_orders(orders, t["users"], n).select("id").collect()]
    assert ids == list(range(249_999, 249_999 - n, -1))


def test_recent_orders_skips_any_number_of_orders_without_a_user(spark, t):
    orders = spark.range(3000).select(
        "id", F.when(F.col("id") < 5, F.lit(101)).otherwise(F.lit(999)).cast("bigint").alias("user_id"),
        F.lit("n").alias("order_number"), F.lit(1).cast("decimal(10,2)").alias("total_amount"),
        F.lit("paid").alias("status"), F.lit(None).cast("string").alias("tracking_number"),
        F.lit(str(ts(1))).cast("timestamp_ntz").alias("order_date"))
    rows = catalog.recent_orders(orders, t["users"], 2).collect()
    assert [r.id for r in rows] == [4, 3]


def test_lookups(spark, t):
    keys = spark.createDataFrame([(1,), (1,), (42,)], "id bigint")
    assert [r.id for r in lookup(t["products"], keys).collect()] == [1]
    feed = spark.createDataFrame(
        [(1, "ANN", "new@x.org"), (2, "new", "BOB@shop.test"), (3, "new", "new@x.org"),
         (4, "bob", "ann@shop.test")], "seq int, username string, email string")
    rows = by_id(registration_conflicts(feed, t["users"]), "seq")
    assert {i: r.conflict for i, r in rows.items()} == {1: "username", 2: "email", 3: None, 4: "username"}
