import pytest
from pyspark.sql import functions as F

from tests.shop import ITEMS, by_id, small_shop
from tillworks.operators import integrity
from tillworks.plans import fulfilment, stock
from tillworks.schemas import ORDER_STATUSES
from tillworks.sources.tables import seed_rows
from tillworks.streaming import stock_stream


@pytest.fixture(scope="module")
def t(spark):
    return small_shop(spark)


def test_ledger_goes_below_zero_and_keeps_null(spark, t):
    more = seed_rows(spark, "order_items", ITEMS + [dict(ITEMS[0], id=9, product_id=9, quantity=3),
                                                    dict(ITEMS[0], id=10, product_id=2, quantity=3)])
    left = {i: r.stock_quantity for i, r in by_id(stock.stock_after_orders(t["products"], more)).items()}
    assert (left[1], left[2], left[3], left[4], left[9]) == (41, -3, 0, 25, None)
    variants = by_id(stock.variant_stock_after_orders(t["product_variants"], more))
    assert {i: r.stock_quantity for i, r in variants.items()} == {1: 29, 2: 26, 3: 30}


def test_ledger_conserves_units(t):
    before = t["products"].agg(F.sum("stock_quantity")).first()[0]
    after = stock.stock_after_orders(t["products"], t["order_items"]).agg(F.sum("stock_quantity")).first()[0]
    assert before - after == sum(i["quantity"] for i in ITEMS)


def _stream(spark, t, tmp_path):
    """The items as three batches; (source, ledger, checkpoint)."""
    src, out, state = (str(tmp_path / n) for n in ("items", "movements", "state"))
    for part in range(3):
        t["order_items"].where(F.col("id") % 3 == part).coalesce(1).write.mode("append").parquet(src)
    stock_stream.start_stock_stream(spark, src, out, state, files_per_batch=1).awaitTermination()
    return src, out, state


def _check(spark, t, out, items):
    for name, kind, batch in (("products", "product", stock.stock_after_orders),
                              ("product_variants", "variant", stock.variant_stock_after_orders)):
        streamed = stock_stream.current_stock(spark, t[name], out, kind)
        expected = batch(t[name], items)
        assert sorted(map(str, streamed.collect())) == sorted(map(str, expected.collect()))


def test_stream_equals_batch_and_survives_a_replayed_batch(spark, t, tmp_path):
    src, out, state = _stream(spark, t, tmp_path)
    items = t["order_items"]
    _check(spark, t, out, items)
    # the driver died after the last batch's files, before the stream took note of it
    commits = sorted((tmp_path / "state" / "commits").glob("[0-9]*"))
    assert len(commits) == 3
    commits[-1].unlink()
    commits[-1].with_name(f".{commits[-1].name}.crc").unlink(missing_ok=True)
    stock_stream.start_stock_stream(spark, src, out, state).awaitTermination()
    _check(spark, t, out, items)
    # a restart picks up new files only
    items.where("id = 1").coalesce(1).write.mode("append").parquet(src)
    stock_stream.start_stock_stream(spark, src, out, state).awaitTermination()
    _check(spark, t, out, items.unionByName(items.where("id = 1")))


def test_readers_see_finished_batches_only_and_prune_days(spark, t, tmp_path):
    _, out, _ = _stream(spark, t, tmp_path)
    whole = sorted(map(tuple, stock.product_movements(t["order_items"]).collect()))
    day = next((tmp_path / "movements").glob("day=*"))
    # files of a batch that did not finish
    stock_stream.movements(t["order_items"]).write.mode("append").parquet(str(day))
    assert sorted(map(tuple, stock_stream.read_movements(spark, out, "product").collect())) == whole
    today = day.name.removeprefix("day=")
    later = stock_stream.read_movements(spark, out, "product", today)
    assert later.isEmpty() and "PartitionFilters: [isnotnull(day" in later._jdf.queryExecution(
        ).executedPlan().toString()
    earlier = stock_stream.read_movements(spark, out, "product", "2020-01-01")
    assert sorted(map(tuple, earlier.collect())) == whole


CHANGES = "order_id bigint, seq int, status string"


def test_status_changes(spark, t):
    feed = spark.createDataFrame(
        [(1000, 1, "shipped"), (1000, 2, "pending"), (1000, 3, "refunded"), (1002, 1, "shipped"),
         (1003, 1, "bogus"), (1004, 2, "cancelled"), (1004, 1, "completed"), (9999, 1, "paid")], CHANGES)
    rows = by_id(fulfilment.apply_status_changes(t["orders"], t["users"], feed))
    assert (rows[1000].status, rows[1000].tracking_number) == ("pending", "TRK819000")
    assert (rows[1002].status, rows[1002].tracking_number) == ("shipped", None)
    assert [rows[i].status for i in (1003, 1004, 1001, 1005)] == ["delivered", "cancelled", "cancelled", None]
    notes = fulfilment.status_notifications(t["orders"], t["users"], feed).collect()
    assert sorted((n.order_id, n.seq) for n in notes) == [(1000, 1), (1000, 2), (1004, 1), (1004, 2)]
    texts = {(n.order_id, n.seq): n for n in notes}
    assert texts[(1000, 1)].status_line.startswith("Tracking Number: TRK819000.")
    assert texts[(1000, 2)].status_line is None
    assert (texts[(1004, 2)].subject, texts[(1004, 2)].status_text, texts[(1004, 2)].total_label) == (
        "Order #ORD-1004 Status Update", "CANCELLED", "$66.67")


def test_clean_shop_has_no_violations_but_the_known_ones(t):
    assert integrity.duplicate_key_report(t).count() == 0
    orphans = [tuple(r) for r in integrity.orphan_report(t).collect()]
    assert orphans == [("cart_items", "product_id", 777, 1)]
    assert integrity.domain_report(t).count() == 0
    assert {r.n for r in integrity.null_report(t).collect()} == {0}


def test_violations_are_found(spark, t):
    users = t["users"].unionByName(t["users"].withColumn("username", F.upper("username")))
    found = {(r.key_name, r.key_value): r.n for r in integrity.duplicate_key_report({"users": users}).collect()}
    assert found == {("username", "ann"): 2, ("username", "bob"): 2, ("username", "root"): 2,
                     ("email", "ann@shop.test"): 2, ("email", "bob@shop.test"): 2, ("email", "root@shop.test"): 2}
    reviews = t["reviews"].withColumn("rating", F.col("id").cast("int") + 1)
    assert [tuple(r)[2:] for r in integrity.domain_report({"reviews": reviews}).collect()] in (
        [("6", 1), ("7", 1)], [("7", 1), ("6", 1)])
    nulls = integrity.null_violations(t["orders"].withColumn("subtotal", F.expr("nullif(id, 1000)")), ["id", "subtotal"])
    assert {r.column_name: r.n for r in nulls.collect()} == {"id": 0, "subtotal": 1}
    pairs = spark.createDataFrame([(1, None), (1, None), (2, 3), (2, 3)], "a int, b int")
    assert [tuple(r) for r in integrity.duplicate_keys(pairs, ["a", "b"]).collect()] == [(2, 3, 2)]
    assert len(ORDER_STATUSES) == 8
