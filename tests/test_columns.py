from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillworks.functions import columns as X


def _apply(spark, fn, values, dtype):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.orderBy("i").select(fn("v")).collect()]


@pytest.mark.parametrize("fn, dtype, pairs", [
    (X.clamp_qty, "string", [("3abc", 3), ("x", 1), ("", 1), (None, 1), ("0", 1), ("-4", 1),
                             (" 7", 7), ("2.9", 2), ("1e1", 10), ("+5", 5),
                             ("99999999999", 99_999_999_999)]),
    (X.whole_number, "string", [("-3.9", -3), ("abc", 0), (None, 0), (".5", 0),
                                ("3000000000", 3_000_000_000), ("-1e300", -(1 << 63))]),
    (X.slugify, "string", [("House & Home", "house-&-home"), ("ÄB c", "Äb-c"), (None, None)]),
    (X.is_filled, "string", [("", False), ("0", False), (None, False), (" ", True), ("00", True)]),
    (X.image_src, "string", [(None, X.FALLBACK_IMAGE), ("\t \n", X.FALLBACK_IMAGE),
                             (" a.jpg\n", "a.jpg"), ("\0", X.FALLBACK_IMAGE)]),
    (X.preview, "string", [(None, "..."), ("ab", "ab..."), ("é" * 90, "é" * 80 + "...")]),
    (X.stars, "double", [(0.0, "☆☆☆☆☆"), (2.5, "★★★☆☆"), (4.49, "★★★★☆"), (5.0, "★★★★★")]),
    (X.money, "decimal(12,3)", [(Decimal("1234567.125"), "1,234,567.13"), (Decimal("0"), "0.00"),
                                (Decimal("0.125"), "0.13")]),
    (X.status_label, "string", [("paid", "Paid"), ("", "")]),
    (X.day_label, "date", [(date(2024, 3, 5), "Mar 05, 2024")]),
    (X.expiry_label, "date", [(None, "No expiry"), (date(2024, 12, 31), "Dec 31, 2024")]),
    (X.tracking_code, "bigint", [(0, "TRK100000"), (1, "TRK107919"), (900000, "TRK100000")]),
    (X.is_email, "string", [("a@b.co", True), ("a.b+c@x-y.example.org", True), ("a@b", False),
                            ("a..b@x.org", False), (".a@x.org", False), ("a b@x.org", False),
                            ("a@-x.org", False), ("", False), (None, False), ("a@@x.org", False)]),
])
def test_helper(spark, fn, dtype, pairs):
    assert _apply(spark, fn, [p[0] for p in pairs], dtype) == [p[1] for p in pairs]


def test_discount_label(spark):
    df = spark.createDataFrame([("percentage", Decimal("10")), ("fixed", Decimal("1234.5"))],
                               "kind string, value decimal(10,2)")
    labels = [r[0] for r in df.select(X.discount_label("kind", "value")).collect()]
    assert labels == ["10.00%", "$1,234.50"]


def test_average_of_nothing_is_null_not_an_error(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 4)], "k int, v int")
    rows = {r.k: r.m for r in df.groupBy("k").agg(X.exact_avg("v").alias("m")).collect()}
    assert rows == {1: None, 2: 4.0}


def test_tracking_codes_do_not_clash_within_900000_ids(spark):
    n = spark.range(5, 900005).select(X.tracking_code("id").alias("c")).agg(
        F.count_distinct("c")).first()[0]
    assert n == 900000
