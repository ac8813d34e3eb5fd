"""Adding products, categories, coupons and users from feeds.

A feed row is added if it passes its check, holds only declared values in enumerated
columns, names known parents, and collides with nothing on a unique key, neither with a
stored row nor with a row added before it. ``seq`` numbers
the feed rows; ids follow the stored ones in that order.
"""

from pyspark.sql import DataFrame, functions as F

from tillworks.operators.changes import append_with_defaults, apply_updates
from tillworks.operators.ids import assign_ids, next_id
from tillworks.operators.inserts import accepted_rows, holding_edits
from tillworks.operators.validation import (accepted, validate_categories, validate_coupons,
                                            validate_products, validate_registrations)
from tillworks.schemas import ENUMS, ID_FLOORS, UNIQUE_KEYS


def _add(table: DataFrame, validated: DataFrame, name: str, as_of, fks=()) -> DataFrame:
    rows = accepted(validated)
    for column, values in ENUMS.get(name, {}).items():
        if column in rows.columns:
            rows = rows.where(F.col(column).isNull() | F.col(column).isin(*values))
    # a key the feed does not fill is NULL in every new row and collides with nothing
    keys = [key for key in UNIQUE_KEYS[name] if set(key) <= set(rows.columns)]
    kept = accepted_rows(table, rows, keys, "seq", fks)
    numbered = assign_ids(kept, ["seq"], next_id(table, ID_FLOORS.get(name, 1))).drop("seq")
    return append_with_defaults(table, numbered, name, as_of)


def add_products(products: DataFrame, feed: DataFrame, as_of, categories=None) -> DataFrame:
    fks = [] if categories is None else [("category_id", categories, "id")]
    return _add(products, validate_products(feed), "products", as_of, fks)


def add_categories(categories: DataFrame, feed: DataFrame, as_of) -> DataFrame:
    return _add(categories, validate_categories(feed), "categories", as_of)


def add_coupons(coupons: DataFrame, feed: DataFrame, as_of) -> DataFrame:
    return _add(coupons, validate_coupons(feed), "coupons", as_of)


# what the edit forms write
PRODUCT_FORM = ["name", "slug", "description", "short_description", "price", "compare_price",
                "category_id", "stock_quantity", "image_url", "is_featured", "is_active"]
CATEGORY_FORM = ["name", "slug"]


def edit_products(products: DataFrame, edits: DataFrame, as_of) -> DataFrame:
    """Write whole edit forms in ``seq`` order; a form is rejected if another product has its slug
    at that moment."""
    valid = accepted(validate_products(edits, editing=True))
    return apply_updates(products, holding_edits(products, valid, ["slug"], "seq"), "id", "seq",
                         PRODUCT_FORM, as_of)


def edit_categories(categories: DataFrame, edits: DataFrame, as_of) -> DataFrame:
    """Write names and slugs in ``seq`` order; one is rejected if another category has its slug
    at that moment."""
    valid = accepted(validate_categories(edits, editing=True))
    return apply_updates(categories, holding_edits(categories, valid, ["slug"], "seq"), "id",
                         "seq", CATEGORY_FORM, as_of)


def register_users(users: DataFrame, feed: DataFrame, as_of) -> DataFrame:
    return _add(users, validate_registrations(feed), "users", as_of)
