import pytest
from pyspark.sql import functions as F

from tests.shop import by_id, small_shop
from tillworks.plans import catalog, reports
from tillworks.schemas import SCHEMAS
from tillworks.session import scratch_path, shared_dir
from tillworks.operators import integrity
from tillworks.sources import snapshots, tables


@pytest.fixture(scope="module")
def t(spark):
    return small_shop(spark)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_round_trip_under_their_schemas(spark, t, tmp_path):
    root = str(tmp_path)
    for name, df in t.items():
        tables.write_table(df, root, name)
    shop = tables.read_shop(spark, root)
    for name in SCHEMAS:
        assert shop[name].schema == SCHEMAS[name]
        assert sorted(map(str, shop[name].collect())) == sorted(map(str, t[name].collect()))


def test_month_folders_are_pruned_and_the_range_reaches_the_scan(spark, t, tmp_path):
    tables.write_table(t["orders"], str(tmp_path), "orders")
    orders = tables.read_orders_by_month(spark, str(tmp_path))
    report = reports.monthly_sales_report(orders, 2024, 1)
    plain = reports.monthly_sales_report(t["orders"], 2024, 1)
    assert report.collect() == plain.collect()
    plan = _plan(report)
    assert "PartitionFilters: [isnotnull(order_month" in plan
    assert "GreaterThanOrEqual(order_date" in plan and "LessThan(order_date" in plan


def test_bucketed_facts_are_not_shuffled(spark, t):
    for name in ("orders", "order_items"):
        tables.save_bucketed(t[name], f"b_{name}", name, 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        totals = reports.order_totals(spark.table("b_orders"), spark.table("b_order_items"))
        assert sorted(totals.collect()) == sorted(reports.order_totals(t["orders"], t["order_items"]).collect())
        assert "Exchange" not in _plan(totals)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_batch_shows_only_once_its_manifest_is_written(spark, t, tmp_path):
    root = str(tmp_path)
    snapshots.publish(spark, root, 1, {"wishlist": t["wishlist"], "cart_items": t["cart_items"]})
    # a later batch whose job died before the manifest
    t["wishlist"].limit(1).write.parquet(f"{root}/wishlist/version=2")
    assert snapshots.latest_batch(spark, root, "wishlist") == 1
    assert snapshots.read_published(spark, root, "wishlist").count() == 3
    # the retry overwrites the leftovers and publishes
    for _ in range(2):
        snapshots.publish(spark, root, 2, {"wishlist": t["wishlist"].where("id > 1")})
    assert set(by_id(snapshots.read_published(spark, root, "wishlist"))) == {2, 3}
    assert snapshots.read_published(spark, root, "cart_items").count() == 4
    with pytest.raises(ValueError):
        snapshots.read_published(spark, root, "orders")


def test_a_reader_keeps_one_batch_for_all_its_tables(spark, t, tmp_path):
    root, names = str(tmp_path), ["wishlist", "cart_items"]
    snapshots.publish(spark, root, 1, {n: t[n] for n in names})
    held = snapshots.read_all_published(spark, root, names)
    # a retry and a later batch, while the reader is at work
    snapshots.publish(spark, root, 1, {n: t[n].limit(1) for n in names})
    snapshots.publish(spark, root, 2, {n: t[n].limit(0) for n in names})
    assert [held[n].count() for n in names] == [3, 4]
    later = snapshots.read_all_published(spark, root, names)
    assert [later[n].count() for n in names] == [0, 0]
    assert all(later[n].schema == t[n].schema for n in names)


def test_scratch_folders_are_new_ones_in_the_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(shared_dir(spark) + "/")


def test_writing_counts_what_the_integrity_reports_would_find(spark, t, tmp_path):
    bad = {"reviews": t["reviews"].withColumn("rating", F.col("id").cast("int") + 1),
           "orders": t["orders"].withColumns({
               "status": F.when(F.col("id") > 1002, "lost").otherwise(F.col("status")),
               "subtotal": F.expr("nullif(subtotal, 100)")}),
           "users": t["users"]}
    counts = {name: tables.write_table(df, str(tmp_path), name) for name, df in bad.items()}
    for name, df in bad.items():
        assert counts[name]["rows", ""] == df.count()
    nulls = {(r.table_name, r.column_name): r.n for r in integrity.null_report(bad).collect()}
    assert nulls == {(n, c): k for n, found in counts.items() for (kind, c), k in found.items()
                     if kind == "nulls"}
    outside = {}
    for r in integrity.domain_report(bad).collect():
        outside[r.table_name, r.column_name] = outside.get((r.table_name, r.column_name), 0) + r.n
    assert outside == {(n, c): k for n, found in counts.items() for (kind, c), k in found.items()
                       if kind == "outside" and k}
    assert outside["orders", "status"] == 3 and nulls["orders", "subtotal"] == 4


def test_recent_orders_read_the_newest_months_only(spark, t, tmp_path):
    """Two orders a month, one of them without a user; one order without a date."""
    base = t["orders"].where("id = 1000").drop("id", "user_id", "order_date")
    made = spark.range(80).select(
        (F.col("id") + 2000).alias("id"),
        F.when(F.col("id") % 2 == 0, F.lit(101)).cast("bigint").alias("user_id"),
        F.when(F.col("id") != 2, F.add_months(F.lit("2020-01-15").cast("date"), (
            F.col("id") / 2).cast("int")).cast("timestamp_ntz")).alias("order_date"))
    rows = made.crossJoin(base).select(*t["orders"].columns)
    tables.write_table(rows, str(tmp_path), "orders")
    orders = tables.read_orders_by_month(spark, str(tmp_path))
    assert len(tables.month_folders(orders)) == 40
    for n in (1, 3, 16, 39, 60):
        found = catalog.recent_orders_by_month(orders, t["users"], n)
        assert found.collect() == catalog.recent_orders(rows, t["users"], n).collect()
    plan = _plan(catalog.recent_orders_by_month(orders, t["users"], 3))
    assert "order_month" in plan and ">= 2023-01" in plan
