"""Feed checks: every row comes back with a reject_reason, NULL when accepted."""

from pyspark.sql import DataFrame, functions as F

from tillworks.functions.columns import ascii_upper, is_email, is_filled, slugify, trimmed
from tillworks.schemas import SETTABLE_STATUSES


def _positive(c):
    return F.coalesce(F.col(c) > 0, F.lit(False))


def validate_products(feed: DataFrame, editing: bool = False) -> DataFrame:
    """A product needs a name and a price above zero; an edit also a positive id."""
    reason = F.when(~is_filled("name"), "name").when(~_positive("price"), "price")
    if editing:
        reason = reason.when(~_positive("id"), "id")
    return feed.withColumns({"slug": slugify("name"), "reject_reason": reason})


def validate_coupons(feed: DataFrame) -> DataFrame:
    """A coupon needs a code, stored in upper case, and a value above zero."""
    reason = (F.when(~is_filled("code"), "code")
              .when(~_positive("discount_value"), "discount_value"))
    return feed.withColumns({"code": ascii_upper("code"), "reject_reason": reason})


def validate_categories(feed: DataFrame, editing: bool = False) -> DataFrame:
    """A category needs a name; an edit also a positive id."""
    reason = F.when(~is_filled("name"), "name")
    if editing:
        reason = reason.when(~_positive("id"), "id")
    return feed.withColumns({"slug": slugify("name"), "reject_reason": reason})


def validate_status_changes(feed: DataFrame) -> DataFrame:
    """Only statuses that may be set by hand; others are ignored."""
    settable = F.coalesce(F.col("status").isin(*SETTABLE_STATUSES), F.lit(False))
    return feed.withColumn("reject_reason", F.when(~settable, "status"))


def validate_registrations(feed: DataFrame) -> DataFrame:
    """A registration needs a well-formed email; both texts are trimmed."""
    clean = feed.withColumns({"username": trimmed(F.coalesce("username", F.lit(""))),
                              "email": trimmed(F.coalesce("email", F.lit("")))})
    return clean.withColumn("reject_reason", F.when(~is_email("email"), "email"))


def accepted(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("reject_reason").isNull()).drop("reject_reason")
