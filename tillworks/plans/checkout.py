"""Pricing carts and placing orders for all buyers in one batch."""

from decimal import Decimal

from pyspark.sql import DataFrame, functions as F

from tillworks.functions.columns import NO_ADDRESS, is_filled, or_label, order_number
from tillworks.operators.changes import append_with_defaults, at, clear_cart
from tillworks.operators.ids import advance, assign_ids, first_free
from tillworks.plans.carts import cart_lines
from tillworks.schemas import ID_FLOORS, MONEY_SUM
from tillworks.session import cut_lineage

# ---- fixed values: pricing rules of the shop ----
TAX_RATE = Decimal("0.10")
FREE_SHIPPING_ABOVE = 100
SHIPPING_FEE = 10
DISCOUNT = 0
DEFAULT_PAYMENT_METHOD = "credit_card"
PLACED_STATUS = "paid"


def _quotes(lines: DataFrame) -> DataFrame:
    subtotal = F.col("subtotal")
    fee = F.when(subtotal > FREE_SHIPPING_ABOVE, F.lit(0)).otherwise(F.lit(SHIPPING_FEE))
    tax = subtotal * F.lit(TAX_RATE)
    sums = lines.groupBy("user_id").agg(F.sum("subtotal").cast(MONEY_SUM).alias("subtotal"))
    return sums.select(
        "user_id",
        subtotal.cast(MONEY_SUM).alias("subtotal"),
        tax.cast(MONEY_SUM).alias("tax_amount"),
        fee.cast(MONEY_SUM).alias("shipping_amount"),
        F.lit(DISCOUNT).cast(MONEY_SUM).alias("discount_amount"),
        (subtotal + tax + fee - F.lit(DISCOUNT)).cast(MONEY_SUM).alias("total_amount"))


def checkout_quotes(cart: DataFrame, products: DataFrame) -> DataFrame:
    """Subtotal, tax, shipping and total per user.

    Shipping is free strictly above 100. A user whose cart holds no existing
    product gets no quote. Amounts are exact decimals, rounded half up to cents
    at the end.
    """
    return _quotes(cart_lines(cart, products))


def place_orders(cart: DataFrame, products: DataFrame, requests: DataFrame, as_of,
                 first_id: int = ID_FLOORS["orders"]):
    """Turn the carts of everyone who pays into orders.

    ``requests`` has request_id (unique), user_id, card_name, payment_method and
    address. A blank card name is rejected. Of several requests of a user the
    first one orders the cart and the others find it empty. Returns
    ``(orders, order items, remaining cart)``; the orders are materialised once,
    and items and cart follow from them. Publish the three under one batch with
    ``sources.snapshots.publish``.
    """
    # one row per paying user, written once: it selects carts and fills orders
    first = cut_lineage(
        requests.where(is_filled("card_name")).groupBy("user_id")
        .agg(F.min_by(F.struct("request_id", "payment_method", "address"),
                      "request_id").alias("_request")))
    # only the carts of those who pay are priced
    lines = cart_lines(cart.join(first.select("user_id"), "user_id", "left_semi"), products)
    address = or_label("_request.address", NO_ADDRESS)
    priced = _quotes(lines).join(first, "user_id").select(
        "user_id", "total_amount", "subtotal", "tax_amount", "shipping_amount",
        "discount_amount", F.lit(PLACED_STATUS).alias("status"),
        F.lit(PLACED_STATUS).alias("payment_status"),
        or_label("_request.payment_method", DEFAULT_PAYMENT_METHOD).alias("payment_method"),
        address.alias("shipping_address"), address.alias("billing_address"),
        at(as_of).alias("order_date"), F.col("_request.request_id").alias("_request_id"))
    orders = (assign_ids(priced, ["_request_id"], first_id).drop("_request_id")
              .withColumn("order_number", order_number("id")))
    placed = orders.select(F.col("id").alias("order_id"), "user_id")
    items = lines.join(placed, "user_id").select(
        "order_id", "product_id", F.lit(None).cast("bigint").alias("variant_id"), "quantity",
        F.col("price").alias("price_at_time"), F.col("subtotal").alias("total_price"))
    return orders, items, clear_cart(cart, placed)


# the requests placed so far, whether they found anything to order or not
LEDGER = "request_id bigint"


def place_orders_once(shop: dict, requests: DataFrame, as_of) -> dict:
    """New versions of the tables after a batch of requests, each request counting once.

    ``shop`` holds products, cart_items, orders, order_items, ``placed_requests`` (the ledger)
    and ``id_counters``. Requests in the ledger are left out, so a batch delivered again orders
    nothing, whatever was put into the carts since. Ids go on from the counters, also after
    deletions. Publish the returned tables as one batch with ``sources.snapshots.publish``: the
    ledger then shows exactly the requests whose orders show.
    """
    ledger, counters = shop["placed_requests"], shop["id_counters"]
    # of the ledger only what the batch names
    named = cut_lineage(requests.select("request_id").distinct())
    known = cut_lineage(ledger.join(named, "request_id", "left_semi"))
    fresh = cut_lineage(requests.join(known, "request_id", "left_anti"))
    start = first_free(counters, "orders", shop["orders"], ID_FLOORS["orders"])
    orders, items, cart = place_orders(shop["cart_items"], shop["products"], fresh, as_of, start)
    counters = advance(counters, "orders", start + orders.count())
    start = first_free(counters, "order_items", shop["order_items"])
    items = cut_lineage(assign_ids(items, ["order_id", "product_id"], start))
    return {
        "orders": append_with_defaults(shop["orders"], orders, "orders", as_of),
        "order_items": append_with_defaults(shop["order_items"], items, "order_items", as_of),
        "cart_items": cart,
        "placed_requests": ledger.unionByName(fresh.select("request_id")),
        "id_counters": cut_lineage(advance(counters, "order_items", start + items.count()))}
