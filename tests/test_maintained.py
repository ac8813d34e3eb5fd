"""States after feeds against states of the facts as they are then."""

import random

from tests.shop import money, small_shop
from tillworks.plans import maintained as M
from tillworks.plans import reports

ITEMS = "order_id bigint, product_id bigint, quantity int, price_at_time decimal(10,2)"


def _rows(df):
    return sorted(map(str, df.collect()))


def test_random_feeds_equal_a_full_recomputation(spark):
    rng = random.Random(4)
    item = lambda: (rng.randrange(12), rng.randrange(5), rng.choice([None, 1, 2, 7]),
                    rng.choice([None, money("1.25"), money("99.99")]))
    held = [item() for _ in range(40)]
    frame = lambda rows: spark.createDataFrame(rows, ITEMS)
    state = M.state_of(frame(held), "order_id", M.item_measures())
    for _ in range(3):
        old, new, lost = held[:6], [item() for _ in range(6)], held[6:14]
        added = [item() for _ in range(7)]
        held = new + held[14:] + added
        feed = M.replaced(frame(old), frame(new)).unionByName(
            M.signed(frame(lost), -1)).unionByName(M.signed(frame(added), 1))
        state = M.refreshed(state, feed, "order_id", M.item_measures())
    assert _rows(state) == _rows(M.state_of(frame(held), "order_id", M.item_measures()))


def test_reports_from_states_equal_the_reports(spark):
    t = small_shop(spark)
    items = M.state_of(t["order_items"], "order_id", M.item_measures())
    ratings = M.state_of(M.approved(t["reviews"]), "product_id", M.rating_measures())
    assert _rows(M.order_totals(t["orders"], items)) == _rows(
        reports.order_totals(t["orders"], t["order_items"]))
    assert _rows(M.order_summary(t["orders"], t["users"], items)) == _rows(
        reports.order_summary(t["orders"], t["users"], t["order_items"]))
    assert _rows(M.product_ratings(t["products"], ratings)) == _rows(
        reports.product_ratings(t["products"], t["reviews"]))


def test_a_deleted_parent_takes_its_key_along_and_feeds_read_no_facts(spark):
    t = small_shop(spark)
    ratings = M.state_of(M.approved(t["reviews"]), "product_id", M.rating_measures())
    left = M.without_keys(ratings, "product_id", spark.createDataFrame([(1,), (8,)], "id bigint"))
    kept = t["reviews"].where("product_id <> 1")
    assert _rows(left) == _rows(M.state_of(M.approved(kept), "product_id", M.rating_measures()))
    gone = M.refreshed(ratings, M.signed(M.approved(t["reviews"]), -1), "product_id",
                       M.rating_measures())
    assert gone.isEmpty()
