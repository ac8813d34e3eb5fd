"""Order status changes and the customer notices they cause."""

from pyspark.sql import DataFrame, functions as F

from tillworks.functions.columns import ascii_upper, dollars, tracking_code
from tillworks.operators.changes import touched, with_values
from tillworks.operators.validation import accepted, validate_status_changes
from tillworks.session import cut_lineage

# ---- fixed values: texts of the status notices ----
STATUS_LINES = {
    "paid": "✅ Payment confirmed! We're processing your order.",
    "cancelled": "⚠️ Your order has been cancelled. Please contact support if this was a mistake.",
    "completed": "🎉 Thank you for shopping with us! We hope you enjoy your purchase.",
}
SHIPPED_LINE = "Your order is on its way! Estimated delivery: 3-5 business days."


def _with_known_user(orders: DataFrame, users: DataFrame) -> DataFrame:
    return orders.join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi")


def apply_status_changes(orders: DataFrame, users: DataFrame, changes: DataFrame,
                         as_of=None) -> DataFrame:
    """Set each order to its last accepted status; any status may follow any other.

    ``changes`` has order_id, status and seq (unique per order). An order shipped
    at any point of the feed gets a tracking code, provided its user exists; the
    code stays through later changes. Only shipped orders are matched with the
    users, not the whole table. With ``as_of``, changed orders get it as updated_at.
    """
    # written once: it picks the shipped orders and meets the whole table
    per_order = cut_lineage(
        accepted(validate_status_changes(changes))
        .groupBy(F.col("order_id").alias("id"))
        .agg(F.max_by("status", "seq").alias("_status"),
             F.bool_or(F.col("status") == "shipped").alias("_shipped")))
    shipped = per_order.where("_shipped").select("id")
    tracked = (
        _with_known_user(orders.select("id", "user_id").join(shipped, "id", "left_semi"), users)
        .select("id", tracking_code("id").alias("_code")))
    fresh = {"status": F.coalesce("_status", "status"),
             "tracking_number": F.coalesce("_code", "tracking_number")}
    return with_values(
        orders.join(per_order.drop("_shipped"), "id", "left").join(tracked, "id", "left"),
        touched(fresh, orders.columns, as_of), orders.columns)


def status_notifications(orders: DataFrame, users: DataFrame, changes: DataFrame) -> DataFrame:
    """The outbox: one notice per accepted change of an order that has a user."""
    people = users.select(F.col("id").alias("user_id"), "username", "email")
    headers = orders.select(F.col("id").alias("order_id"), "user_id", "order_number",
                            "total_amount")
    line = F.when(F.col("status") == "shipped", F.concat(
        F.lit("Tracking Number: "), tracking_code("order_id"), F.lit(". "), F.lit(SHIPPED_LINE)))
    for status, text in STATUS_LINES.items():
        line = line.when(F.col("status") == status, text)
    return (
        accepted(validate_status_changes(changes))
        .join(headers, "order_id").join(people, "user_id")
        .select("order_id", "seq", "order_number", "username", "email",
                F.concat(F.lit("Order #"), "order_number", F.lit(" Status Update")).alias("subject"),
                ascii_upper("status").alias("status_text"),
                dollars("total_amount").alias("total_label"),
                line.alias("status_line")))
