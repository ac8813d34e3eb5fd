"""Guest sessions: one row per visitor with a nested cart and wishlist."""

from pyspark.sql import DataFrame, functions as F


def explode_guest_carts(sessions: DataFrame) -> DataFrame:
    """One row per session cart line; empty carts yield nothing."""
    others = [c for c in sessions.columns if c not in ("cart", "wishlist")]
    return sessions.select(*others, F.explode("cart").alias("_line")).select(
        *others, "_line.product_id", "_line.quantity")


def explode_guest_wishlists(sessions: DataFrame) -> DataFrame:
    """One row per distinct wishlist entry of a session."""
    others = [c for c in sessions.columns if c not in ("cart", "wishlist")]
    return sessions.select(*others, F.explode(F.array_distinct("wishlist")).alias("product_id"))


def add_to_guest_cart(cart, product_id, quantity):
    """A session cart after one add of at least one piece: the first line of the
    product grows, or a line is appended."""
    quantity = F.greatest(quantity, F.lit(1))
    place = F.array_position(F.transform(cart, lambda line: line["product_id"]), product_id)
    has = place > 0
    grown = F.transform(cart, lambda line, i: F.when(
        i == place - 1,
        F.struct(line["product_id"].alias("product_id"),
                 (line["quantity"] + quantity).alias("quantity"))).otherwise(line))
    new_line = F.struct(product_id.alias("product_id"), quantity.alias("quantity"))
    return F.when(has, grown).otherwise(F.array_append(cart, new_line))


def add_to_guest_wishlist(wishlist, product_id):
    """A session wishlist after one add; a listed product is not added again."""
    return F.when(F.array_contains(wishlist, product_id), wishlist).otherwise(
        F.array_append(wishlist, product_id))
