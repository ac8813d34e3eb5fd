"""The shop's stored routines as SQL functions over named tables.

The scalar functions hold a correlated subquery, which Spark turns into a
grouped left join: a query calling one for every row runs set-based, like the
report of the same purpose in ``plans.reports``.
"""

from pyspark.sql import SparkSession

ROUTINE_TABLES = ("products", "orders", "order_items")
VIEW_PREFIX = "shop_"

_ROUTINES = """
CREATE OR REPLACE TEMPORARY FUNCTION calculate_order_total(wanted BIGINT)
RETURNS DECIMAL(20,2)
RETURN CAST(coalesce((SELECT sum(i.price_at_time * i.quantity) FROM shop_order_items i
                      WHERE i.order_id = wanted), 0) AS DECIMAL(20,2));

CREATE OR REPLACE TEMPORARY FUNCTION get_user_order_count(wanted BIGINT)
RETURNS BIGINT
RETURN (SELECT count(*) FROM shop_orders o
        WHERE o.user_id = wanted AND o.status NOT IN ('cancelled', 'refunded'));

CREATE OR REPLACE TEMPORARY FUNCTION get_low_stock_products(threshold INT)
RETURNS TABLE (id BIGINT, name STRING, sku STRING, stock_quantity INT, category_id BIGINT)
RETURN SELECT p.id, p.name, p.sku, p.stock_quantity, p.category_id FROM shop_products p
       WHERE p.stock_quantity BETWEEN 1 AND threshold
       ORDER BY p.stock_quantity, p.id;

CREATE OR REPLACE TEMPORARY FUNCTION get_monthly_sales_report(wanted_year INT, wanted_month INT)
RETURNS TABLE (sale_date DATE, order_count BIGINT, total_sales DECIMAL(20,2),
               total_tax DECIMAL(20,2), total_shipping DECIMAL(20,2), avg_order_value DOUBLE)
RETURN SELECT to_date(o.order_date), count(*),
              CAST(sum(o.total_amount) AS DECIMAL(20,2)), CAST(sum(o.tax_amount) AS DECIMAL(20,2)),
              CAST(sum(o.shipping_amount) AS DECIMAL(20,2)),
              CAST(sum(o.total_amount) AS DOUBLE) / count(o.total_amount)
       FROM shop_orders o
       WHERE o.order_date >= make_timestamp_ntz(wanted_year, wanted_month, 1, 0, 0, 0)
         AND o.order_date < make_timestamp_ntz(wanted_year + wanted_month DIV 12,
                                               wanted_month % 12 + 1, 1, 0, 0, 0)
         AND o.status NOT IN ('cancelled', 'refunded')
       GROUP BY to_date(o.order_date)
       ORDER BY to_date(o.order_date) DESC
"""


def register_tables(tables: dict) -> None:
    """Publish tables as temporary views named shop_<table>."""
    for name, df in tables.items():
        df.createOrReplaceTempView(VIEW_PREFIX + name)


def register_routines(spark: SparkSession) -> None:
    """Create the functions; the views of ROUTINE_TABLES must exist."""
    for statement in _ROUTINES.split(";"):
        spark.sql(statement)
