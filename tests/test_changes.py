from decimal import Decimal

import pytest

from tests.shop import by_id, money, small_shop
from tillworks.operators import changes as C
from tillworks.operators import validation as V

AS_OF = "2024-02-01 00:00:00"


@pytest.fixture(scope="module")
def t(spark):
    return small_shop(spark)


def test_append_fills_only_absent_columns(spark, t):
    rows = spark.createDataFrame([(200, "New", "new", Decimal("5.00"), None)],
                                 "id bigint, name string, slug string, price decimal(10,2), views int")
    out = C.append_with_defaults(t["products"], rows, "products", AS_OF)
    row = by_id(out)[200]
    assert out.columns == t["products"].columns and out.count() == 10
    assert (row.stock_quantity, row.is_active, row.is_featured) == (0, True, False)
    assert row.views is None and row.sku is None
    assert str(row.created_at) == AS_OF


def test_latest_update_wins_and_may_write_null(spark, t):
    feed = spark.createDataFrame(
        [(1, 1, Decimal("1.00"), "a"), (1, 3, Decimal("3.00"), None), (1, 2, Decimal("2.00"), "b"),
         (999, 1, Decimal("9.00"), "z")], "id bigint, seq int, price decimal(10,2), description string")
    out = by_id(C.apply_updates(t["products"], feed, "id", "seq", ["price", "description"]))
    assert (out[1].price, out[1].description) == (money("3.00"), None)
    assert out[2].price == money("199.99") and 999 not in out


def test_toggle_uses_the_submitted_value(spark, t):
    feed = spark.createDataFrame([(1, 1, True), (2, 1, False), (3, 1, None), (3, 0, False)],
                                 "id bigint, seq int, current boolean")
    active = by_id(C.apply_toggles(t["products"], feed, "is_active"))
    assert [active[i].is_active for i in (1, 2, 3, 4)] == [False, True, False, True]
    featured = by_id(C.apply_toggles(t["products"], feed, "is_featured"))
    assert [featured[i].is_featured for i in (1, 2, 3, 4)] == [False, True, True, False]


def test_delete_checks_the_owner(spark, t):
    keys = spark.createDataFrame([(1, 101), (2, 101)], "id bigint, user_id bigint")
    assert set(by_id(C.delete_keys(t["cart_items"], keys, ["id", "user_id"]))) == {2, 3, 4}


def test_administrators_cannot_delete_themselves(spark):
    asks = spark.createDataFrame([(100, 100), (100, 101), (None, 102)], "admin_id bigint, user_id bigint")
    assert {r.id for r in C.deletable_users(asks).collect()} == {101, 102}


def test_product_delete_reaches_every_child(spark, t):
    gone = spark.createDataFrame([(3,)], "id bigint")
    out = C.cascade_delete(t, "products", gone)
    assert set(by_id(out["products"])) == {1, 2, 4, 5, 6, 7, 8, 9}
    assert out["product_variants"].count() == 0
    assert set(by_id(out["order_items"])) == {1, 3, 5, 6}
    assert set(by_id(out["reviews"])) == {1, 2, 3, 6}
    assert set(by_id(out["cart_items"])) == {1, 2, 4}
    assert out["orders"].count() == 6 and out["users"].count() == 3


def test_variant_delete_keeps_items_without_variant(spark, t):
    gone = spark.createDataFrame([(1,)], "id bigint")
    items = by_id(C.cascade_delete(t, "product_variants", gone)["order_items"])
    assert {i: r.variant_id for i, r in items.items()} == {1: None, 2: None, 3: None, 4: 2, 5: None, 6: None}


def test_user_delete_keeps_orders_without_user(spark, t):
    gone = spark.createDataFrame([(101,)], "id bigint")
    out = C.cascade_delete(t, "users", gone)
    orders = by_id(out["orders"])
    assert [orders[i].user_id for i in (1000, 1002, 1003)] == [None, None, 102]
    assert set(by_id(out["wishlist"])) == {3}
    assert set(by_id(out["cart_items"])) == {2, 3, 4}
    assert set(by_id(out["reviews"])) == {2, 3, 5}


def test_order_delete_takes_its_items(spark, t):
    gone = spark.createDataFrame([(1000,)], "id bigint")
    assert set(by_id(C.cascade_delete(t, "orders", gone)["order_items"])) == {3, 4, 5}


def test_category_delete_uncategorises_products_and_lifts_children(spark, t):
    gone = spark.createDataFrame([(3,)], "id bigint")
    out = C.cascade_delete(t, "categories", gone)
    assert by_id(out["products"])[4].category_id is None
    assert by_id(out["products"])[5].category_id == 4
    assert by_id(out["categories"])[4].parent_id is None
    assert out["products"].columns == t["products"].columns


def test_ensure_column_is_idempotent(t):
    before = t["users"].drop("is_premium")
    after = C.ensure_column(before, "is_premium", False)
    assert {r.is_premium for r in after.collect()} == {False}
    assert C.ensure_column(t["users"], "is_premium", False) is t["users"]


def _reasons(df, key="id"):
    return {r[key]: r.reject_reason for r in df.collect()}


def test_feed_checks(spark):
    feed = spark.createDataFrame(
        [(1, "ok", Decimal("1")), (2, "", Decimal("1")), (3, "0", Decimal("1")), (4, None, Decimal("1")),
         (5, "ok", Decimal("0")), (6, "ok", Decimal("-1")), (7, "ok", None), (0, "ok", Decimal("1"))],
        "id bigint, name string, price decimal(10,2)")
    expected = {1: None, 2: "name", 3: "name", 4: "name", 5: "price", 6: "price", 7: "price"}
    assert _reasons(V.validate_products(feed)) == {**expected, 0: None}
    assert _reasons(V.validate_products(feed, editing=True)) == {**expected, 0: "id"}
    assert V.accepted(V.validate_products(feed)).count() == 2
    names = V.validate_categories(feed.drop("price"), editing=True)
    assert _reasons(names) == {1: None, 2: "name", 3: "name", 4: "name", 5: None, 6: None, 7: None, 0: "id"}


def test_coupon_status_and_registration_checks(spark):
    coupons = spark.createDataFrame([(1, "abc", Decimal("1")), (2, "", Decimal("1")), (3, "x", Decimal("0"))],
                                    "id int, code string, discount_value decimal(10,2)")
    checked = V.validate_coupons(coupons)
    assert _reasons(checked) == {1: None, 2: "code", 3: "discount_value"}
    assert by_id(checked)[1].code == "ABC"
    statuses = spark.createDataFrame([(1, "paid"), (2, "refunded"), (3, "bogus"), (4, None), (5, "delivered")],
                                     "id int, status string")
    assert _reasons(V.validate_status_changes(statuses)) == {
        1: None, 2: "status", 3: "status", 4: "status", 5: None}
    people = spark.createDataFrame([(1, " ann ", " ann@x.org "), (2, "b", ""), (3, None, "c@x.org")],
                                   "id int, username string, email string")
    rows = by_id(V.validate_registrations(people))
    assert (rows[1].username, rows[1].email, rows[1].reject_reason) == ("ann", "ann@x.org", None)
    assert (rows[2].reject_reason, rows[3].username) == ("email", "")


def test_conform_casts_and_completes(spark):
    out = C.conform(spark.createDataFrame([("1", "7")], "id string, price string"), "products")
    row = out.first()
    assert (row.id, row.price, row.name) == (1, money("7.00"), None)
    assert len(out.columns) == 17


def test_only_changed_rows_are_touched(spark, t):
    feed = spark.createDataFrame([(1, 1, Decimal("1.00")), (2, 1, money("199.99"))],
                                 "id bigint, seq int, price decimal(10,2)")
    out = by_id(C.apply_updates(t["products"], feed, "id", "seq", "price", AS_OF))
    before = by_id(t["products"])
    assert str(out[1].updated_at) == AS_OF
    assert out[2].price == before[2].price and out[2].updated_at == before[2].updated_at
    assert out[3].updated_at == before[3].updated_at
