"""Time the headline queries and print one JSON line.

Each query is run once to warm up and then BENCH_RUNS times; the median counts.
The whole result is forced with the noop writer.
"""

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tillworks import registry  # noqa: E402
from tillworks.session import build_session  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = [
    "top_selling_products", "top_selling_products_valid", "product_ratings", "order_summary",
    "monthly_sales_report", "order_totals", "user_order_counts", "low_stock_products",
    "catalog_listing", "category_product_counts", "admin_kpis", "recent_orders",
    "account_summary", "cart_after_adds", "cart_after_login_merge", "checkout_quotes",
    "placed_orders", "stock_after_orders", "variant_stock_after_orders", "stock_stream",
    "orders_after_status_changes", "status_notifications", "products_after_updates",
    "users_replace_into", "reviews_insert_ignore", "order_items_after_product_delete",
    "order_id_assignment", "registration_conflicts", "dq_duplicate_keys", "dq_orphans",
]


def seconds(spark, name):
    begin = time.perf_counter()
    registry.run(name, spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main():
    names = os.environ["BENCH_QUERIES"].split(",") if "BENCH_QUERIES" in os.environ else HEADLINE
    if names == ["all"]:
        names = list(registry.QUERIES)
    spark = build_session(
        "bench", f"local[{CPUS}]", **{
            "spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "12g",
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
            # no Python call sites in error messages, which cost time per expression
            "spark.python.sql.dataFrameDebugging.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        seconds(spark, name)
        times[name] = round(statistics.median(seconds(spark, name) for _ in range(RUNS)), 4)
    print(json.dumps({
        "metric": "sum of median query times", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": FOLDER.rsplit("sf", 1)[-1], "runs": RUNS,
        "cpus": int(CPUS), "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
