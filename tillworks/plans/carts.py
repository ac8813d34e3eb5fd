"""Carts and wishlists of all users at once."""

from pyspark.sql import DataFrame, functions as F

from tillworks.functions.columns import clamp_qty, fits_int, line_total, money_total
from tillworks.operators.changes import apply_updates, delete_keys
from tillworks.operators.ids import assign_ids, next_id
from tillworks.plans.reports import payments_made
from tillworks.schemas import MONEY_SUM
from tillworks.session import cut_lineage
from tillworks.sources.sessions import explode_guest_carts, explode_guest_wishlists

CART_KEY = ["user_id", "product_id"]


def _absent(adds: DataFrame, stored: DataFrame) -> DataFrame:
    """The grouped adds whose (user, product) is not stored yet.

    The stored pairs are first cut down to those the feed names, so a small feed
    is all that is ever shuffled or broadcast, however large the table.
    """
    hits = stored.select(*CART_KEY).join(adds.select(*CART_KEY), CART_KEY)
    return adds.join(hits, CART_KEY, "left_anti")


def _with_parents(adds: DataFrame, products, users) -> DataFrame:
    """The grouped adds that name a known product and a known user, where these are given.

    The parents go into the joins as they are read, so that a hot key can be split.
    """
    for column, parent in (("product_id", products), ("user_id", users)):
        if parent is not None:
            adds = adds.join(parent.select(F.col("id").alias(column)), column, "left_semi")
    return adds


def _numbered_after(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """New rows with the ids that follow the stored ones."""
    return assign_ids(fresh, CART_KEY, next_id(stored))


def cart_upsert(cart: DataFrame, adds: DataFrame, products=None, users=None) -> DataFrame:
    """Add quantities to the cart line of (user, product), creating it if absent.

    Adds that name a product or user missing from the given tables are left out, and so are
    those whose quantity no 32-bit column holds; sums of the others are 64-bit.

    ``adds`` has user_id, product_id, a raw quantity and created_at. Stored
    quantities and creation times are kept as they are, added quantities are at
    least 1. Lines that were not there before get the next free ids.
    """
    columns = ["id", *CART_KEY, "variant_id", "quantity", "created_at", "updated_at"]
    # the grouped feed is used for growing and for finding absent lines
    grouped = adds.where(fits_int("quantity")).groupBy(*CART_KEY).agg(
        F.sum(clamp_qty("quantity")).alias("_added"),
        F.min("created_at").alias("_first"), F.max("created_at").alias("_last"))
    added = cut_lineage(_with_parents(grouped, products, users))
    grown = cart.join(added, CART_KEY, "left").select(
        "id", *CART_KEY, "variant_id",
        (F.col("quantity") + F.coalesce("_added", F.lit(0))).alias("quantity"),
        "created_at",
        F.greatest("updated_at", "_last").alias("updated_at"))
    fresh = _numbered_after(cart, _absent(added, cart)).select(
        "id", *CART_KEY, F.lit(None).cast("bigint").alias("variant_id"),
        F.col("_added").alias("quantity"), F.col("_first").alias("created_at"),
        F.col("_last").alias("updated_at"))
    return grown.unionByName(fresh).select(*columns)


def wishlist_add(wishlist: DataFrame, adds: DataFrame, products=None, users=None) -> DataFrame:
    """Add (user, product) pairs that are not listed yet; the earliest add wins.

    Adds that name a product or user missing from the given tables are left out.

    ``adds`` has user_id, product_id and added_at. A stored row is never changed.
    """
    wanted = cut_lineage(_with_parents(adds.groupBy(*CART_KEY).agg(
        F.min("added_at").alias("added_at")), products, users))
    fresh = _numbered_after(wishlist, _absent(wanted, wishlist))
    return wishlist.unionByName(fresh.select(*wishlist.columns))


def wishlist_to_cart(wishlist: DataFrame, cart: DataFrame, moves: DataFrame, products=None,
                     users=None):
    """Move pairs to the cart with quantity 1 each; returns (wishlist, cart)."""
    return delete_keys(wishlist, moves, CART_KEY), cart_with_moves(
        cart, moves, products, users)


def cart_with_moves(cart: DataFrame, moves: DataFrame, products=None, users=None) -> DataFrame:
    """The cart after moves; a line is added even if the product was not on the wishlist."""
    return cart_upsert(cart, moves.select(*CART_KEY, F.lit(1).alias("quantity"), "created_at"),
                       products, users)


def merge_guest(sessions: DataFrame, cart: DataFrame, wishlist: DataFrame, products=None,
                users=None):
    """Fold the session carts and wishlists of users who logged in into their own.

    Returns (cart, wishlist). ``sessions`` carries logged_in_at.
    """
    return (merge_guest_carts(sessions, cart, products, users),
            merge_guest_wishlists(sessions, wishlist, products, users))


def _logged_in(sessions: DataFrame) -> DataFrame:
    return sessions.where(F.col("user_id").isNotNull())


def merge_guest_carts(sessions: DataFrame, cart: DataFrame, products=None,
                      users=None) -> DataFrame:
    adds = explode_guest_carts(_logged_in(sessions))
    return cart_upsert(cart, adds.withColumnRenamed("logged_in_at", "created_at"), products, users)


def merge_guest_wishlists(sessions: DataFrame, wishlist: DataFrame, products=None,
                          users=None) -> DataFrame:
    adds = explode_guest_wishlists(_logged_in(sessions))
    return wishlist_add(wishlist, adds.withColumnRenamed("logged_in_at", "added_at"), products,
                        users)


def set_cart_quantities(cart: DataFrame, edits: DataFrame, as_of=None) -> DataFrame:
    """Set the quantity of a user's own lines; the latest edit of a line wins.

    An edit whose quantity no 32-bit column holds is rejected, so the one before it stands.
    With ``as_of``, lines whose quantity changes get it as ``updated_at``.
    """
    clamped = edits.where(fits_int("quantity")).select(
        "id", "user_id", "seq", clamp_qty("quantity").cast("int").alias("quantity"))
    return apply_updates(cart, clamped, ["id", "user_id"], "seq", "quantity", as_of).select(
        *cart.columns)


def cart_lines(cart: DataFrame, products: DataFrame) -> DataFrame:
    """Cart lines at today's price; lines of missing products drop out."""
    priced = products.select(F.col("id").alias("product_id"), "name", "price", "image_url")
    return cart.join(priced, "product_id").select(
        "id", "user_id", "product_id", "name", "image_url", "price", "quantity",
        line_total("quantity", "price").cast(MONEY_SUM).alias("subtotal"))


def cart_totals(cart: DataFrame, products: DataFrame) -> DataFrame:
    """Pieces and value per user."""
    return cart_lines(cart, products).groupBy("user_id").agg(
        F.sum("quantity").alias("cart_count"), money_total("subtotal").alias("cart_total"))


def guest_cart_lines(sessions: DataFrame, products: DataFrame) -> DataFrame:
    """Session cart lines at today's price."""
    priced = products.select(F.col("id").alias("product_id"), "name", "price")
    return explode_guest_carts(sessions).join(priced, "product_id").select(
        "session_id", "product_id", "name", "price", "quantity",
        line_total("quantity", "price").cast(MONEY_SUM).alias("subtotal"))


def guest_cart_totals(sessions: DataFrame, products: DataFrame) -> DataFrame:
    return guest_cart_lines(sessions, products).groupBy("session_id").agg(
        money_total("subtotal").alias("cart_total"))


def guest_badges(sessions: DataFrame) -> DataFrame:
    """Pieces in the session cart and length of its wishlist, without a lookup."""
    pieces = F.aggregate("cart", F.lit(0).cast("bigint"),
                         lambda total, line: total + line["quantity"])
    return sessions.select("session_id", F.coalesce(pieces, F.lit(0).cast("bigint")).alias("cart_count"),
                           F.coalesce(F.size("wishlist"), F.lit(0)).cast("bigint").alias("wish_count"))


def wishlist_items(wishlist: DataFrame, products: DataFrame) -> DataFrame:
    """Wishlist entries with the product shown next to them."""
    shown = products.select(F.col("id").alias("product_id"), "name", "price", "image_url",
                            "stock_quantity")
    return wishlist.withColumnRenamed("id", "wish_id").join(shown, "product_id").select(
        "wish_id", "user_id", "product_id", "name", "price", "image_url", "stock_quantity")


def wishlist_counts(wishlist: DataFrame) -> DataFrame:
    return wishlist.groupBy("user_id").agg(F.count(F.lit(1)).alias("wish_count"))


def account_summary(users, cart, products, wishlist, orders) -> DataFrame:
    """Cart, wishlist and payments of every customer, zeros where there is nothing."""
    zero = F.lit(0).cast("bigint")
    return (
        users.where(F.col("role") == "user").select(F.col("id").alias("user_id"), "username")
        .join(cart_totals(cart, products), "user_id", "left")
        .join(wishlist_counts(wishlist), "user_id", "left")
        .join(payments_made(orders), "user_id", "left")
        .select("user_id", "username",
                F.coalesce("cart_count", zero).alias("cart_count"),
                F.coalesce("cart_total", F.lit(0)).cast(MONEY_SUM).alias("cart_total"),
                F.coalesce("wish_count", zero).alias("wish_count"),
                F.coalesce("payments", zero).alias("payments"))
    )
