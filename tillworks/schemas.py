"""Table schemas, keys, foreign keys, value domains and defaults of the shop.

Identifiers are ``bigint``. Timestamps are ``timestamp_ntz``: the shop stores
wall-clock times, and a zone-free type keeps range filters on them pushable to
the Parquet scan whatever the session time zone is.
"""

from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)
# Totals of many lines get more digits, so that one huge cart or order cannot
# overflow and fail the batch it is in.
MONEY_SUM = T.DecimalType(20, 2)

_LONG, _INT, _STR = T.LongType(), T.IntegerType(), T.StringType()
_BOOL, _TS, _DATE = T.BooleanType(), T.TimestampNTZType(), T.DateType()


def _struct(**columns):
    return T.StructType([T.StructField(n, t, True) for n, t in columns.items()])


# Credentials are deliberately not part of the users schema.
SCHEMAS = {
    "users": _struct(
        id=_LONG, username=_STR, email=_STR, full_name=_STR, phone=_STR, address=_STR,
        role=_STR, is_active=_BOOL, last_login=_TS, created_at=_TS, updated_at=_TS,
        is_premium=_BOOL),
    "categories": _struct(
        id=_LONG, name=_STR, slug=_STR, description=_STR, parent_id=_LONG,
        image_url=_STR, is_active=_BOOL, created_at=_TS),
    "products": _struct(
        id=_LONG, name=_STR, slug=_STR, description=_STR, short_description=_STR,
        price=MONEY, compare_price=MONEY, category_id=_LONG, stock_quantity=_INT,
        sku=_STR, image_url=_STR, gallery_images=_STR, is_featured=_BOOL,
        is_active=_BOOL, views=_INT, created_at=_TS, updated_at=_TS),
    "product_variants": _struct(
        id=_LONG, product_id=_LONG, variant_name=_STR, variant_value=_STR,
        additional_price=MONEY, stock_quantity=_INT, sku=_STR, image_url=_STR),
    "orders": _struct(
        id=_LONG, user_id=_LONG, order_number=_STR, tracking_number=_STR,
        total_amount=MONEY_SUM, subtotal=MONEY_SUM, tax_amount=MONEY_SUM,
        shipping_amount=MONEY_SUM, discount_amount=MONEY_SUM, status=_STR, payment_status=_STR, payment_method=_STR,
        shipping_address=_STR, billing_address=_STR, notes=_STR, order_date=_TS,
        updated_at=_TS),
    "order_items": _struct(
        id=_LONG, order_id=_LONG, product_id=_LONG, variant_id=_LONG, quantity=_INT,
        price_at_time=MONEY, total_price=MONEY_SUM),
    "reviews": _struct(
        id=_LONG, product_id=_LONG, user_id=_LONG, rating=_INT, title=_STR,
        comment=_STR, is_approved=_BOOL, created_at=_TS, updated_at=_TS),
    "cart_items": _struct(
        id=_LONG, user_id=_LONG, product_id=_LONG, variant_id=_LONG, quantity=_INT,
        created_at=_TS, updated_at=_TS),
    "wishlist": _struct(id=_LONG, user_id=_LONG, product_id=_LONG, added_at=_TS),
    "coupons": _struct(
        id=_LONG, code=_STR, description=_STR, discount_type=_STR, discount_value=MONEY,
        min_order_amount=MONEY, max_discount=MONEY, usage_limit=_INT, used_count=_INT,
        start_date=_DATE, end_date=_DATE, is_active=_BOOL, created_at=_TS),
}

GUEST_SESSIONS = T.StructType([
    T.StructField("session_id", _STR),
    T.StructField("user_id", _LONG),
    T.StructField("cart", T.ArrayType(_struct(product_id=_LONG, quantity=_INT))),
    T.StructField("wishlist", T.ArrayType(_LONG)),
    T.StructField("logged_in_at", _TS),
])

# ---- fixed values: keys, domains and defaults of the shop's data model ----

ORDER_STATUSES = ["pending", "processing", "paid", "shipped", "delivered",
                  "completed", "cancelled", "refunded"]
PAYMENT_STATUSES = ["pending", "paid", "failed", "refunded"]
USER_ROLES = ["user", "admin"]
DISCOUNT_TYPES = ["percentage", "fixed"]

VOID_STATUSES = ["cancelled", "refunded"]
# Statuses an administrator may set; a refund cannot be set by hand.
SETTABLE_STATUSES = [s for s in ORDER_STATUSES if s != "refunded"]
# Orders a customer sees as paid for; "delivered" is not among them.
PAYMENT_MADE_STATUSES = ["paid", "shipped", "completed"]
REVENUE_STATUSES = ["completed", "paid"]

UNIQUE_KEYS = {
    "users": [["username"], ["email"]],
    "categories": [["slug"]],
    "products": [["slug"], ["sku"]],
    "product_variants": [["sku"]],
    "orders": [["order_number"]],
    "reviews": [["product_id", "user_id"]],
    "cart_items": [["user_id", "product_id"]],
    "wishlist": [["user_id", "product_id"]],
    "coupons": [["code"]],
}
# Compared without regard to case, as the shop's text collation does.
CASE_INSENSITIVE = {"username", "email", "code"}

CASCADE, SET_NULL = "cascade", "set null"
# (child table, column, parent table, what a parent's deletion does)
FOREIGN_KEYS = [
    ("categories", "parent_id", "categories", SET_NULL),
    ("products", "category_id", "categories", SET_NULL),
    ("product_variants", "product_id", "products", CASCADE),
    ("orders", "user_id", "users", SET_NULL),
    ("order_items", "order_id", "orders", CASCADE),
    ("order_items", "product_id", "products", CASCADE),
    ("order_items", "variant_id", "product_variants", SET_NULL),
    ("reviews", "product_id", "products", CASCADE),
    ("reviews", "user_id", "users", CASCADE),
    ("cart_items", "product_id", "products", CASCADE),
    ("cart_items", "variant_id", "product_variants", SET_NULL),
    ("cart_items", "user_id", "users", CASCADE),
    ("wishlist", "user_id", "users", CASCADE),
    ("wishlist", "product_id", "products", CASCADE),
]

ENUMS = {
    "users": {"role": USER_ROLES},
    "orders": {"status": ORDER_STATUSES, "payment_status": PAYMENT_STATUSES},
    "coupons": {"discount_type": DISCOUNT_TYPES},
}
RANGES = {"reviews": {"rating": (1, 5)}}

NOT_NULL = {
    "users": ["username", "email"],
    "categories": ["name", "slug"],
    "products": ["name", "slug", "price"],
    "product_variants": ["product_id", "variant_name", "variant_value"],
    "orders": ["order_number", "total_amount", "subtotal"],
    "order_items": ["order_id", "product_id", "quantity", "price_at_time", "total_price"],
    "reviews": ["product_id", "user_id"],
    "cart_items": ["user_id", "product_id", "quantity"],
    "wishlist": ["user_id", "product_id"],
    "coupons": ["code", "discount_value"],
}

NOW = "now"  # stands for the as_of moment given to the job
DEFAULTS = {
    "users": {"role": "user", "is_active": True, "is_premium": False,
              "created_at": NOW, "updated_at": NOW},
    "categories": {"is_active": True, "created_at": NOW},
    "products": {"stock_quantity": 0, "is_featured": False, "is_active": True,
                 "views": 0, "created_at": NOW, "updated_at": NOW},
    "product_variants": {"additional_price": 0, "stock_quantity": 0},
    "orders": {"tax_amount": 0, "shipping_amount": 0, "discount_amount": 0,
               "status": "pending", "payment_status": "pending", "order_date": NOW,
               "updated_at": NOW},
    "order_items": {},
    "reviews": {"is_approved": False, "created_at": NOW, "updated_at": NOW},
    "cart_items": {"quantity": 1, "created_at": NOW, "updated_at": NOW},
    "wishlist": {"added_at": NOW},
    "coupons": {"discount_type": "percentage", "min_order_amount": 0, "usage_limit": 1,
                "used_count": 0, "is_active": True, "created_at": NOW},
}

# First identifier handed out in an empty table.
ID_FLOORS = {"users": 100, "categories": 100, "products": 100, "orders": 1000}
