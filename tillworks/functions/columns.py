"""Column helpers: each takes and returns a Column and stays JVM-side."""

import string

from pyspark.sql import Column, functions as F

from tillworks.schemas import MONEY, MONEY_SUM

# ---- fixed values: labels and formats of the shop's pages ----
FALLBACK_IMAGE = "img/placeholder.jpg"
UNCATEGORIZED = "Uncategorized"
ALL_PRODUCTS = "All Products"
NO_CATEGORY = "-"
NO_TRACKING = "Not assigned"
NO_ADDRESS = "No address provided"
NO_EXPIRY = "No expiry"
PREVIEW_CHARS = 80
DAY_FORMAT = "MMM dd, yyyy"
BLANKS = " \t\n\r\0\x0b"
LEADING_NUMBER = r"^[ \t\n\r\x0B\f]*([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?)"
EMAIL = (r"^[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+(\.[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+)*"
         r"@([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?$")
MAX_INT = 2147483647


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c) -> Column:
    return F.translate(_col(c), string.ascii_uppercase, string.ascii_lowercase)


def ascii_upper(c) -> Column:
    return F.translate(_col(c), string.ascii_lowercase, string.ascii_uppercase)


def slugify(c) -> Column:
    """ASCII lower case with blanks turned into hyphens; other marks stay."""
    return F.translate(_col(c), string.ascii_uppercase + " ", string.ascii_lowercase + "-")


def trimmed(c) -> Column:
    return F.btrim(_col(c), F.lit(BLANKS))


def is_filled(c) -> Column:
    """True unless the text is NULL, empty or the single character 0."""
    return F.coalesce(~_col(c).isin("", "0"), F.lit(False))


def whole_number(c) -> Column:
    """The leading number of a text cut to a 64-bit integer; 0 when there is none."""
    number = F.regexp_extract(_col(c).cast("string"), LEADING_NUMBER, 1).try_cast("double")
    # least and greatest skip NULLs, so the missing number is settled first
    found = F.coalesce(number, F.lit(0.0))
    ends = F.least(found, F.lit(float((1 << 63) - 1024))), F.lit(float(-(1 << 63)))
    return F.greatest(*ends).cast("bigint")


def clamp_qty(c) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), whole_number(c))


def fits_int(c) -> Column:
    """Whether a stored 32-bit column can hold the number typed."""
    return F.abs(whole_number(c).cast("decimal(20,0)")) <= MAX_INT


def line_total(quantity, price) -> Column:
    return _col(price) * _col(quantity).cast("decimal(10,0)")


def money_total(c) -> Column:
    return F.sum(c).cast(MONEY_SUM)


def exact_avg(c) -> Column:
    """sum/count as double: the same bits whatever the order of the rows."""
    c = _col(c)
    return F.sum(c).cast("double") / F.nullif(F.count(c), F.lit(0))


def status_label(c) -> Column:
    c = _col(c)
    return F.concat(ascii_upper(F.substring(c, 1, 1)), F.substring(c, 2, MAX_INT))


def image_src(c) -> Column:
    clean = trimmed(F.coalesce(_col(c), F.lit("")))
    return F.when(clean == "", F.lit(FALLBACK_IMAGE)).otherwise(clean)


def preview(c) -> Column:
    """First 80 characters and three dots, which follow short texts too."""
    return F.concat(F.substring(F.coalesce(_col(c), F.lit("")), 1, PREVIEW_CHARS), F.lit("..."))


def stars(average) -> Column:
    full = F.round(_col(average)).cast("int")
    return F.concat(F.repeat(F.lit("★"), full), F.repeat(F.lit("☆"), 5 - full))


def money(c) -> Column:
    """Two decimals with thousands separators; rounded exactly, then formatted."""
    return F.format_number(_col(c).cast(MONEY_SUM), 2)


def dollars(c) -> Column:
    return F.concat(F.lit("$"), money(c))


def day_label(c) -> Column:
    return F.date_format(_col(c), DAY_FORMAT)


def or_label(c, label) -> Column:
    return F.coalesce(_col(c), F.lit(label))


def discount_label(kind, value) -> Column:
    return (F.when(_col(kind) == "percentage",
                   F.concat(_col(value).cast(MONEY).cast("string"), F.lit("%")))
            .otherwise(dollars(value)))


def expiry_label(c) -> Column:
    return or_label(day_label(c), NO_EXPIRY)


def order_number(order_id) -> Column:
    return F.concat(F.lit("ORD-"), _col(order_id).cast("string"))


def tracking_code(order_id) -> Column:
    """Six digits from the order id; 7919 is coprime to 900000, so no two of
    900000 consecutive ids share a code."""
    digits = F.lit(100000) + (_col(order_id).cast("bigint") * 7919) % 900000
    return F.concat(F.lit("TRK"), digits.cast("string"))


def is_email(c) -> Column:
    return F.coalesce(_col(c).rlike(EMAIL), F.lit(False))
