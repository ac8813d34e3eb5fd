"""Stock ledgers: what inserted order items take from products and variants."""

from pyspark.sql import DataFrame, functions as F

from tillworks.operators.changes import touched, with_values


def product_movements(new_items: DataFrame) -> DataFrame:
    """Units taken per product."""
    return new_items.groupBy(F.col("product_id").alias("id")).agg(F.sum("quantity").alias("taken"))


def variant_movements(new_items: DataFrame) -> DataFrame:
    """Units taken per variant; items without a variant take none."""
    return (new_items.where(F.col("variant_id").isNotNull())
            .groupBy(F.col("variant_id").alias("id")).agg(F.sum("quantity").alias("taken")))


def apply_movements(stocked: DataFrame, movements: DataFrame, as_of=None) -> DataFrame:
    """Opening stock less the units taken; may go below zero, NULL stays NULL.

    With ``as_of``, rows whose stock changes get it as ``updated_at``, where they have one.
    """
    left = F.col("stock_quantity").cast("bigint") - F.coalesce("taken", F.lit(0))
    fresh = touched({"stock_quantity": left}, stocked.columns, as_of)
    return with_values(stocked.join(movements, "id", "left"), fresh, stocked.columns)


def stock_after_orders(products: DataFrame, new_items: DataFrame, as_of=None) -> DataFrame:
    return apply_movements(products, product_movements(new_items), as_of)


def variant_stock_after_orders(variants: DataFrame, new_items: DataFrame) -> DataFrame:
    """Variant stock after the items; the products' own stock falls as well."""
    return apply_movements(variants, variant_movements(new_items))
