from decimal import Decimal

import pytest

from tests.shop import by_id, small_shop
from tillworks.plans import administration as A

AS_OF = "2024-02-01 00:00:00"


@pytest.fixture(scope="module")
def t(spark):
    return small_shop(spark)


def test_products_are_added_once_per_slug(spark, t):
    feed = spark.createDataFrame(
        [(1, "Thing 1", Decimal("5")), (2, "Lamp X", Decimal("6")), (3, "lamp x", Decimal("7")),
         (4, "", Decimal("8")), (5, "Desk", Decimal("9"))], "seq bigint, name string, price decimal(10,2)")
    rows = by_id(A.add_products(t["products"], feed, AS_OF))
    assert {i: r.slug for i, r in rows.items() if i >= 100} == {100: "lamp-x", 101: "desk"}
    assert (rows[100].price, rows[100].stock_quantity, rows[100].is_active) == (Decimal("6.00"), 0, True)


def test_coupon_codes_collide_without_case(spark, t):
    feed = spark.createDataFrame([(1, "ten", Decimal("5")), (2, "new", Decimal("5")), (3, "NEW", Decimal("6"))],
                                 "seq bigint, code string, discount_value decimal(10,2)")
    rows = by_id(A.add_coupons(t["coupons"], feed, AS_OF))
    assert {i: (r.code, r.usage_limit) for i, r in rows.items() if i > 2} == {3: ("NEW", 1)}


def test_categories_get_ids_from_their_floor(spark, t):
    feed = spark.createDataFrame([(1, "Gadgets"), (2, "0"), (3, "Toys & Games")], "seq bigint, name string")
    rows = by_id(A.add_categories(t["categories"], feed, AS_OF))
    assert {i: r.slug for i, r in rows.items() if i > 4} == {100: "toys-&-games"}


def test_registrations_see_the_ones_before_them(spark, t):
    feed = spark.createDataFrame(
        [(1, "ANN", "x1@shop.test"), (2, "eve", "Bob@Shop.test"), (3, "eve", "eve@shop.test"),
         (4, "EVE", "other@shop.test"), (5, "dan", "EVE@shop.test"), (6, "dan", "dan@shop.test"),
         (7, "kim", "not an email")], "seq bigint, username string, email string")
    rows = by_id(A.register_users(t["users"], feed, AS_OF))
    added = {i: (r.username, r.email, r.role, r.is_premium) for i, r in rows.items() if i > 102}
    assert added == {103: ("eve", "eve@shop.test", "user", False), 104: ("dan", "dan@shop.test", "user", False)}
