import pytest
from pyspark.sql import functions as F

from tests.shop import by_id, money, small_shop, ts
from tillworks.operators import ids
from tillworks.plans import carts, checkout
from tillworks.schemas import GUEST_SESSIONS
from tillworks.sources import snapshots
from tillworks.sources.sessions import add_to_guest_cart, add_to_guest_wishlist

ADDS = "user_id bigint, product_id bigint, quantity string, created_at timestamp_ntz"
LIKES = "user_id bigint, product_id bigint, added_at timestamp_ntz"


@pytest.fixture(scope="module")
def t(spark):
    return small_shop(spark)


def _lines(cart):
    return {(r.user_id, r.product_id): (r.id, r.quantity) for r in cart.collect()}


def test_upsert_adds_clamps_and_numbers_new_lines(spark, t):
    adds = spark.createDataFrame(
        [(101, 8, "2", ts(12)), (101, 8, "-5", ts(11)), (101, 1, "x", ts(12)), (100, 2, "3", ts(9)),
         (101, 1, "4", ts(8))], ADDS)
    out = carts.cart_upsert(t["cart_items"], adds)
    assert _lines(out) == {(101, 8): (1, 4), (102, 9): (2, 10), (102, 3): (3, 2), (100, 777): (4, 3),
                           (100, 2): (5, 3), (101, 1): (6, 5)}
    line = by_id(out)[1]
    assert (line.created_at, line.updated_at) == (ts(10), ts(12))
    assert by_id(out)[6].created_at == ts(8)


def test_quantities_beyond_the_stored_type_are_rejected(spark, t):
    adds = spark.createDataFrame(
        [(101, 8, "2147483648", ts(12)), (101, 8, "2", ts(11)), (101, 1, "9e30", ts(12)),
         (100, 2, "2147483647", ts(9)), (100, 2, "2147483647x", ts(9))], ADDS)
    lines = _lines(carts.cart_upsert(t["cart_items"], adds))
    before = _lines(t["cart_items"])
    assert lines[101, 8] == (1, before[101, 8][1] + 2) and (101, 1) not in lines
    assert lines[100, 2][1] == 2 * 2147483647
    edits = spark.createDataFrame([(1, 101, 1, "7"), (1, 101, 2, "3000000000")],
                                  "id bigint, user_id bigint, seq int, quantity string")
    out = carts.set_cart_quantities(t["cart_items"], edits)
    assert by_id(out)[1].quantity == 7 and out.schema == t["cart_items"].schema


def test_adds_need_known_products_and_users_and_keep_creation_times(spark, t):
    adds = spark.createDataFrame([(101, 8, "2", ts(1)), (101, -5, "1", ts(2)), (555, 8, "1", ts(2))],
                                 ADDS)
    out = carts.cart_upsert(t["cart_items"], adds, t["products"], t["users"])
    assert out.count() == t["cart_items"].count() and by_id(out)[1].created_at == ts(10)
    likes = adds.select("user_id", "product_id", F.col("created_at").alias("added_at"))
    listed = carts.wishlist_add(t["wishlist"], likes, t["products"], t["users"])
    assert {r.product_id for r in listed.collect()} >= {8} and not listed.where(
        "product_id < 0 or user_id = 555").count()


def test_upsert_conserves_quantity(spark, t):
    adds = spark.range(500).select(
        (F.col("id") % 7).alias("user_id"), (F.col("id") % 3 * 5).alias("product_id"),
        (F.col("id") % 4 + 1).cast("string").alias("quantity"),
        F.lit(str(ts(1))).cast("timestamp_ntz").alias("created_at"))
    out = carts.cart_upsert(t["cart_items"], adds)
    total = sum(r.quantity for r in out.collect())
    assert total == 16 + sum(i % 4 + 1 for i in range(500))


def test_wishlist_add_is_idempotent_and_keeps_stored_rows(spark, t):
    adds = spark.createDataFrame([(101, 1, ts(1)), (102, 5, ts(9)), (102, 5, ts(8)), (100, 5, ts(7))], LIKES)
    once = carts.wishlist_add(t["wishlist"], adds)
    rows = {(r.user_id, r.product_id): (r.id, r.added_at) for r in once.collect()}
    assert rows[(101, 1)] == (1, ts(4))
    assert rows[(100, 5)] == (4, ts(7)) and rows[(102, 5)] == (5, ts(8))
    twice = carts.wishlist_add(once, adds)
    assert sorted(map(str, twice.collect())) == sorted(map(str, once.collect()))


def test_move_adds_to_the_cart_even_without_a_wish(spark, t):
    moves = spark.createDataFrame([(101, 1, ts(12)), (102, 9, ts(12)), (102, 9, ts(13))],
                                  "user_id bigint, product_id bigint, created_at timestamp_ntz")
    wishlist, cart = carts.wishlist_to_cart(t["wishlist"], t["cart_items"], moves)
    assert set(by_id(wishlist)) == {2, 3}
    assert _lines(cart)[(101, 1)] == (5, 1) and _lines(cart)[(102, 9)] == (2, 12)


@pytest.fixture(scope="module")
def sessions(spark):
    return spark.createDataFrame([
        ("a", 101, [(8, 3), (2, 0)], [1, 3, 3], ts(20)),
        ("b", None, [(1, 2), (555, 4)], [], ts(20)),
        ("c", 102, [], [1], ts(21)),
    ], GUEST_SESSIONS)


def test_guest_badges_lines_and_totals(t, sessions):
    badges = by_id(carts.guest_badges(sessions), "session_id")
    assert {i: tuple(r[1:]) for i, r in badges.items()} == {"a": (3, 3), "b": (6, 0), "c": (0, 1)}
    lines = carts.guest_cart_lines(sessions, t["products"]).collect()
    assert {(r.session_id, r.product_id, r.subtotal) for r in lines} == {
        ("a", 8, money("300.00")), ("a", 2, money("0.00")), ("b", 1, money("199.98"))}
    totals = by_id(carts.guest_cart_totals(sessions, t["products"]), "session_id")
    assert {i: r.cart_total for i, r in totals.items()} == {"a": money("300.00"), "b": money("199.98")}


def test_login_merge_leaves_anonymous_sessions_alone(t, sessions):
    cart, wishlist = carts.merge_guest(sessions, t["cart_items"], t["wishlist"])
    assert _lines(cart) == {(101, 8): (1, 4), (102, 9): (2, 10), (102, 3): (3, 2), (100, 777): (4, 3),
                            (101, 2): (5, 1)}
    assert {(r.user_id, r.product_id) for r in wishlist.collect()} == {
        (101, 1), (101, 2), (102, 1), (101, 3)}


def test_guest_session_adds(sessions):
    grown = sessions.select("session_id", add_to_guest_cart(F.col("cart"), F.lit(8).cast("bigint"), F.lit(2)).alias("c"),
                            add_to_guest_wishlist(F.col("wishlist"), F.lit(1).cast("bigint")).alias("w"))
    rows = by_id(grown, "session_id")
    assert [tuple(x) for x in rows["a"].c] == [(8, 5), (2, 0)] and rows["a"].w == [1, 3, 3]
    assert [tuple(x) for x in rows["c"].c] == [(8, 2)] and rows["b"].w == [1]


def test_cart_edits_need_the_owner_and_clamp(spark, t):
    edits = spark.createDataFrame([(1, 102, 1, "9"), (2, 102, 1, "0"), (3, 102, 1, "8"), (3, 102, 2, "5x")],
                                  "id bigint, user_id bigint, seq int, quantity string")
    rows = by_id(carts.set_cart_quantities(t["cart_items"], edits))
    assert {i: r.quantity for i, r in rows.items()} == {1: 1, 2: 1, 3: 5, 4: 3}


def test_account_summary(t):
    rows = by_id(carts.account_summary(t["users"], t["cart_items"], t["products"], t["wishlist"],
                                       t["orders"]), "user_id")
    assert tuple(rows[101][2:]) == (1, money("100.00"), 2, 1)
    assert tuple(rows[102][2:]) == (12, money("149.98"), 1, 0)
    assert 100 not in rows


def test_quotes_at_the_shipping_limit(t):
    rows = by_id(checkout.checkout_quotes(t["cart_items"], t["products"]), "user_id")
    # exactly 100.00 pays the fee; a cart of missing products gets no quote
    assert tuple(rows[101][1:]) == (money("100.00"), money("10.00"), money("10.00"), money("0.00"), money("120.00"))
    assert tuple(rows[102][1:]) == (money("149.98"), money("15.00"), money("0.00"), money("0.00"), money("164.98"))
    assert 100 not in rows


REQUESTS = ("request_id bigint, user_id bigint, card_name string, payment_method string, "
            "address string")


def test_orders_are_placed_once_per_user(spark, t):
    requests = spark.createDataFrame(
        [(9, 101, "Ann", "paypal", None), (5, 102, "", None, "Road 1"), (7, 102, "Bob", None, "Road 2"),
         (8, 102, "Bob", "paypal", "Road 3"), (1, 100, "Root", None, None), (2, 999, "Nobody", None, None)], REQUESTS)
    orders, items, cart = checkout.place_orders(
        t["cart_items"], t["products"], requests, "2024-02-01 00:00:00")
    rows = by_id(orders)
    assert set(rows) == {1000, 1001}
    assert (rows[1000].user_id, rows[1000].payment_method, rows[1000].shipping_address) == (
        102, "credit_card", "Road 2")
    assert (rows[1001].order_number, rows[1001].billing_address) == ("ORD-1001", "No address provided")
    assert {(r.order_id, r.product_id, r.quantity) for r in items.collect()} == {
        (1000, 9, 10), (1000, 3, 2), (1001, 8, 1)}
    per_order = items.groupBy("order_id").agg(F.sum("total_price").alias("s")).collect()
    assert {r.order_id: r.s for r in per_order} == {i: r.subtotal for i, r in rows.items()}
    # the cart that could not be ordered stays
    assert set(by_id(cart)) == {4}


def test_a_batch_delivered_again_orders_nothing_and_ids_are_not_given_twice(spark, tmp_path):
    t, root = small_shop(spark), str(tmp_path)
    names = ["cart_items", "orders", "order_items", "placed_requests", "id_counters"]
    shop = t | {"placed_requests": spark.createDataFrame([], checkout.LEDGER),
                "id_counters": ids.no_counters(spark)}
    requests = spark.createDataFrame(
        [(1, 102, "Bob", None, "Here"), (2, 101, "", None, None), (3, 101, "Ann", None, None)],
        "request_id bigint, user_id bigint, card_name string, payment_method string, address string")

    def deliver(batch, batch_id):
        snapshots.publish(spark, root, batch_id,
                          checkout.place_orders_once(shop, batch, "2024-02-01 00:00:00"))
        shop.update(snapshots.read_all_published(spark, root, names))
        return {r.id for r in shop["orders"].collect()}, shop["cart_items"].count()

    before = {r.id for r in t["orders"].collect()}
    assert deliver(requests, 1) == (before | {1006, 1007}, 1)
    # the carts are full again, the newest order is deleted, and the batch comes once more
    shop["cart_items"] = t["cart_items"]
    shop["orders"] = shop["orders"].where("id < 1007")
    assert deliver(requests, 2) == (before | {1006}, 4)
    again = requests.withColumn("request_id", requests["request_id"] + 10)
    assert deliver(requests.unionByName(again), 3) == (before | {1006, 1008, 1009}, 1)
    assert shop["placed_requests"].count() == 6
    held = [r.id for r in shop["order_items"].collect()]
    assert len(held) == len(set(held))


def test_counters_do_not_go_back(spark):
    rows = spark.createDataFrame([(7,)], "id bigint")
    counters = ids.no_counters(spark)
    assert ids.first_free(counters, "a", rows) == 8
    first, counters = ids.reserve(counters, "a", rows, 5)
    assert (first, ids.first_free(counters, "a", rows.limit(0))) == (8, 13)
    assert ids.first_free(ids.advance(counters, "a", 2), "a", rows) == 13
    assert ids.first_free(counters, "b", rows.limit(0), 100) == 100
