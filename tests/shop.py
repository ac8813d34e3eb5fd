"""A small hand-made shop with the edge cases the reports must get right."""

from datetime import date, datetime
from decimal import Decimal

from tillworks.sources.tables import seed_rows


def ts(day, hour=0):
    return datetime(2024, 1, day, hour)


def money(text):
    return Decimal(text)


CATEGORIES = [
    dict(id=1, name="Gadgets", slug="gadgets"),
    dict(id=2, name="Garments", slug="garments"),
    dict(id=3, name="Paper", slug="paper"),
    dict(id=4, name="House & Home", slug="house-home", parent_id=3),
]
USERS = [
    dict(id=100, username="root", email="root@shop.test", role="admin", is_active=True,
         created_at=ts(1), is_premium=True),
    dict(id=101, username="Ann", email="ann@shop.test", role="user", is_active=True,
         created_at=ts(2), is_premium=False),
    dict(id=102, username="bob", email="bob@shop.test", role="user", is_active=True,
         created_at=ts(2), is_premium=True),
]
_STOCK = [50, 0, 5, 25, 0, 12, 15, 40, None]
_PRICE = ["99.99", "199.99", "24.99", "45.99", "12.99", "599.99", "1299.99", "100.00", "10.00"]
_CATEGORY = [1, 1, 2, 3, 4, 4, 1, 2, None]
PRODUCTS = [
    dict(id=i + 1, name=f"Thing {i + 1}", slug=f"thing-{i + 1}", price=money(_PRICE[i]),
         category_id=_CATEGORY[i], stock_quantity=_STOCK[i], sku=f"T-{i + 1}", is_active=True,
         is_featured=False, image_url=[None, " ", "\t\n", "a.jpg", " b.jpg "][i % 5],
         description=None if i == 0 else "x" * 100)
    for i in range(9)
]
VARIANTS = [
    dict(id=i + 1, product_id=3, variant_name="Size", variant_value=v, stock_quantity=30,
         sku=f"T-3-{v}", additional_price=money("0"))
    for i, v in enumerate(["S", "M", "L"])
]


def _order(i, user, status, day, total="100.00"):
    return dict(id=i, user_id=user, order_number=f"ORD-{i}", status=status,
                payment_status="paid", total_amount=money(total), subtotal=money(total),
                tax_amount=money("1.10"), shipping_amount=money("0"), order_date=ts(day, 12))


ORDERS = [
    _order(1000, 101, "paid", 5), _order(1001, 101, "cancelled", 6),
    _order(1002, None, "shipped", 6), _order(1003, 102, "delivered", 7, "33.33"),
    _order(1004, 102, "pending", 7, "66.67"), _order(1005, 101, None, 8),
]


def _item(i, order, product, quantity, price, variant=None):
    return dict(id=i, order_id=order, product_id=product, variant_id=variant, quantity=quantity,
                price_at_time=money(price), total_price=money(price) * quantity)


ITEMS = [
    _item(1, 1000, 1, 2, "99.99"), _item(2, 1000, 3, 1, "24.99", 1), _item(3, 1001, 1, 5, "99.99"),
    _item(4, 1002, 3, 4, "20.00", 2), _item(5, 1003, 1, 1, "90.00"), _item(6, 1000, 1, 1, "99.99"),
]


def _review(i, product, user, rating, approved=True):
    return dict(id=i, product_id=product, user_id=user, rating=rating, is_approved=approved,
                created_at=ts(3))


REVIEWS = [
    _review(1, 1, 101, 5), _review(2, 1, 102, 4), _review(3, 1, 100, None),
    _review(4, 3, 101, 3), _review(5, 3, 102, 1, False), _review(6, 4, 101, 2),
]


def _cart(i, user, product, quantity):
    return dict(id=i, user_id=user, product_id=product, quantity=quantity, created_at=ts(10),
                updated_at=ts(10))


CART = [_cart(1, 101, 8, 1), _cart(2, 102, 9, 10), _cart(3, 102, 3, 2), _cart(4, 100, 777, 3)]
WISHLIST = [dict(id=1, user_id=101, product_id=1, added_at=ts(4)),
            dict(id=2, user_id=101, product_id=2, added_at=ts(5)),
            dict(id=3, user_id=102, product_id=1, added_at=ts(6))]
COUPONS = [
    dict(id=1, code="TEN", discount_type="percentage", discount_value=money("10"),
         min_order_amount=money("50"), end_date=date(2024, 3, 5)),
    dict(id=2, code="TWENTY", discount_type="fixed", discount_value=money("1234.50"),
         min_order_amount=money("0")),
]
_ROWS = {"categories": CATEGORIES, "users": USERS, "products": PRODUCTS,
         "product_variants": VARIANTS, "orders": ORDERS, "order_items": ITEMS,
         "reviews": REVIEWS, "cart_items": CART, "wishlist": WISHLIST, "coupons": COUPONS}


def small_shop(spark):
    return {name: seed_rows(spark, name, rows) for name, rows in _ROWS.items()}


def by_id(df, key="id"):
    return {r[key]: r for r in df.collect()}
