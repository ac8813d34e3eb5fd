"""SQL for every query, over the tables of ``oracles.tables``."""

from oracles.tables import with_tables
from tillworks.plans.fulfilment import SHIPPED_LINE, STATUS_LINES

_ZERO = "CAST(0 AS BIGINT)"
_TRACK = "'TRK' || (100000 + {0} * 7919 % 900000)"
_MONEY = "format('{{:,.2f}}', CAST({0} AS DOUBLE))"
_DAY = "strftime({0}, '%b %d, %Y')"
_LABEL = "upper(substr({0}, 1, 1)) || substr({0}, 2)"
_VALID = "status NOT IN ('cancelled', 'refunded')"
_AS_OF = "TIMESTAMP '2024-02-01 00:00:00'"
_ITEMS = "order_id, product_id, variant_id, quantity, price_at_time, total_price"

_SOLD = """
    SELECT p.id, p.name, p.slug, p.price, p.image_url,
           CAST(coalesce(s.units, 0) AS BIGINT) AS total_sold,
           coalesce(s.n, 0) AS times_ordered
    FROM products p
    LEFT JOIN (SELECT product_id, sum(quantity) AS units, count(DISTINCT order_id) AS n
               FROM order_items {where} GROUP BY product_id) s ON s.product_id = p.id"""

_CATALOG = f"""
    SELECT p.id, p.name, coalesce(c.name, 'Uncategorized') AS category,
           CASE WHEN coalesce(trim(p.image_url, ' ' || chr(9) || chr(10)), '') = ''
                THEN 'img/placeholder.jpg'
                ELSE trim(p.image_url, ' ' || chr(9) || chr(10)) END AS image,
           coalesce(p.stock_quantity, 0) > 0 AS in_stock,
           coalesce(r.mean, 0) AS avg_rating,
           repeat('★', CAST(round(coalesce(r.mean, 0)) AS BIGINT))
               || repeat('☆', 5 - CAST(round(coalesce(r.mean, 0)) AS BIGINT)) AS stars,
           coalesce(r.n, 0) AS review_count,
           substr(coalesce(p.description, ''), 1, 80) || '...' AS blurb,
           {_MONEY.format('p.price')} AS price_label
    FROM products p
    LEFT JOIN categories c ON c.id = p.category_id
    LEFT JOIN (SELECT product_id, count(*) AS n,
                      CAST(sum(rating) AS DOUBLE) / nullif(count(rating), 0) AS mean
               FROM reviews GROUP BY product_id) r ON r.product_id = p.id"""

_RECENT = f"""
    SELECT o.id, o.order_number, u.username, u.email, o.total_amount,
           '$' || {_MONEY.format('o.total_amount')} AS total_label,
           {_LABEL.format('o.status')} AS status_label,
           coalesce(o.tracking_number, 'Not assigned') AS tracking,
           {_DAY.format('o.order_date')} AS day, o.order_date
    FROM shop_orders o JOIN users u ON u.id = o.user_id
    ORDER BY o.order_date DESC, o.id DESC LIMIT """


def _quoted(text):
    return "'" + text.replace("'", "''") + "'"


def _upserted(adds):
    """A cart after additive adds, new lines numbered after the stored ones."""
    return f"""
    SELECT coalesce(id, (SELECT max(id) FROM cart_items)
                        + row_number() OVER (PARTITION BY id IS NULL ORDER BY user_id, product_id)) AS id,
           user_id, product_id, quantity, created_at, updated_at
    FROM (SELECT max(id) AS id, user_id, product_id, CAST(sum(quantity) AS BIGINT) AS quantity,
                 coalesce(min(created_at) FILTER (WHERE id IS NOT NULL), min(created_at)) AS created_at,
                 max(updated_at) AS updated_at
          FROM (SELECT id, user_id, product_id, quantity, created_at, updated_at FROM cart_items
                UNION ALL
                SELECT * FROM ({adds}) a(id, user_id, product_id, quantity, created_at, updated_at)
                WHERE product_id IN (SELECT id FROM products) AND user_id IN (SELECT id FROM users))
          GROUP BY user_id, product_id)"""


def _wished(adds):
    """A wishlist after adds of absent pairs, new rows numbered after the stored ones."""
    return f"""
    SELECT id, user_id, product_id, added_at FROM wishlist
    UNION ALL
    SELECT (SELECT max(id) FROM wishlist) + row_number() OVER (ORDER BY user_id, product_id),
           user_id, product_id, min(added_at)
    FROM ({adds}) a
    WHERE NOT EXISTS (SELECT 1 FROM wishlist w
                      WHERE w.user_id = a.user_id AND w.product_id = a.product_id)
      AND product_id IN (SELECT id FROM products) AND user_id IN (SELECT id FROM users)
    GROUP BY user_id, product_id"""


def _duplicates(parts):
    return "\nUNION ALL\n".join(
        f"""SELECT '{table}' AS table_name, '{key}' AS key_name, CAST({value} AS VARCHAR) AS key_value,
                   count(*) AS n
            FROM {source} WHERE {value} IS NOT NULL GROUP BY {value} HAVING count(*) > 1"""
        for table, key, value, source in parts)


def _orphans(parts):
    return "\nUNION ALL\n".join(
        f"""SELECT '{child}' AS table_name, '{fk}' AS column_name, CAST({fk} AS BIGINT) AS missing_id,
                   count(*) AS n
            FROM {source} WHERE {fk} IS NOT NULL AND {fk} NOT IN ({parents}) GROUP BY {fk}"""
        for child, fk, source, parents in parts)


def _nulls(parts):
    return "\nUNION ALL\n".join(
        f"""SELECT '{table}' AS table_name, '{column}' AS column_name,
                   count(*) FILTER (WHERE {value} IS NULL) AS n FROM {source}"""
        for table, column, value, source in parts)


_LEFT_PRODUCTS = "SELECT p_partkey FROM part WHERE p_size < 45"
_LEFT_USERS = "SELECT c_custkey FROM customer WHERE c_acctbal >= 0"
_LEFT_ORDERS = "SELECT id FROM shop_orders WHERE status <> 'cancelled'"
_LEFT_VARIANTS = "SELECT id FROM product_variants WHERE variant_value <> 'Large'"
_LEFT_CATEGORIES = "SELECT id FROM categories WHERE parent_id IS DISTINCT FROM 103"

_BODIES = {
    # ---- reports ----
    "top_selling_products": _SOLD.format(where=""),
    "top_selling_products_valid": _SOLD.format(
        where=f"WHERE order_id IN (SELECT id FROM shop_orders WHERE {_VALID})"),
    "product_ratings": """
        SELECT p.id, p.name, p.slug, coalesce(r.mean, 0) AS avg_rating,
               coalesce(r.n, 0) AS review_count, coalesce(r.high, 0) AS five_star,
               coalesce(r.middle, 0) AS three_star, coalesce(r.low, 0) AS low_rating
        FROM products p
        LEFT JOIN (SELECT product_id, count(*) AS n,
                          CAST(sum(rating) AS DOUBLE) / nullif(count(rating), 0) AS mean,
                          count(*) FILTER (WHERE rating IN (4, 5)) AS high,
                          count(*) FILTER (WHERE rating = 3) AS middle,
                          count(*) FILTER (WHERE rating IN (1, 2)) AS low
                   FROM reviews WHERE is_approved GROUP BY product_id) r ON r.product_id = p.id""",
    "product_ratings_kept": """
        SELECT p.id, p.name, p.slug, coalesce(r.mean, 0) AS avg_rating,
               coalesce(r.n, 0) AS review_count, coalesce(r.high, 0) AS five_star,
               coalesce(r.middle, 0) AS three_star, coalesce(r.low, 0) AS low_rating
        FROM products p
        LEFT JOIN (SELECT product_id, count(*) AS n,
                          CAST(sum(stars) AS DOUBLE) / nullif(count(stars), 0) AS mean,
                          count(*) FILTER (WHERE stars IN (4, 5)) AS high,
                          count(*) FILTER (WHERE stars = 3) AS middle,
                          count(*) FILTER (WHERE stars IN (1, 2)) AS low
                   FROM (SELECT product_id, user_id, is_approved,
                                CASE WHEN id % 5 = 0 THEN 5 ELSE rating END AS stars
                         FROM (SELECT *, 0 AS late FROM all_reviews WHERE event_type = 'view'
                               UNION ALL
                               SELECT *, 1 FROM all_reviews
                               WHERE event_type = 'error' AND id % 23 <> 0 AND id % 19 <> 0)
                         QUALIFY row_number() OVER (
                             PARTITION BY product_id, user_id ORDER BY late, id) = 1)
                   WHERE is_approved AND user_id NOT IN (SELECT id FROM deleted_users)
                   GROUP BY product_id) r ON r.product_id = p.id""",
    "order_totals_kept": """
        SELECT o.id, CAST(coalesce(sum(i.quantity * i.price_at_time), 0) AS DECIMAL(20,2)) AS order_total
        FROM shop_orders o LEFT JOIN (
            SELECT * FROM order_items
            WHERE product_id NOT IN (SELECT p_partkey FROM part WHERE p_size >= 45)) i
          ON i.order_id = o.id GROUP BY o.id""",
    "order_summary_kept": """
        SELECT o.id, o.order_number, o.total_amount, o.status, o.payment_status, o.order_date,
               u.username, u.email, coalesce(i.n, 0) AS item_count, i.units AS total_items
        FROM shop_orders o
        LEFT JOIN users u ON u.id = o.user_id
        LEFT JOIN (SELECT order_id, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS units
                   FROM order_items
                   WHERE product_id NOT IN (SELECT p_partkey FROM part WHERE p_size >= 45)
                   GROUP BY order_id) i ON i.order_id = o.id""",
    "order_summary": """
        SELECT o.id, o.order_number, o.total_amount, o.status, o.payment_status, o.order_date,
               u.username, u.email, coalesce(i.n, 0) AS item_count, i.units AS total_items
        FROM shop_orders o
        LEFT JOIN users u ON u.id = o.user_id
        LEFT JOIN (SELECT order_id, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS units
                   FROM order_items GROUP BY order_id) i ON i.order_id = o.id""",
    "monthly_sales_report": f"""
        SELECT CAST(order_date AS DATE) AS sale_date, count(*) AS order_count,
               CAST(sum(total_amount) AS DECIMAL(20,2)) AS total_sales,
               CAST(sum(tax_amount) AS DECIMAL(20,2)) AS total_tax,
               CAST(sum(shipping_amount) AS DECIMAL(20,2)) AS total_shipping,
               CAST(sum(total_amount) AS DOUBLE) / count(total_amount) AS avg_order_value
        FROM shop_orders
        WHERE strftime(order_date, '%Y-%m') = '1998-10' AND {_VALID}
        GROUP BY 1""",
    "order_totals": """
        SELECT o.id, CAST(coalesce(sum(i.quantity * i.price_at_time), 0) AS DECIMAL(20,2)) AS order_total
        FROM shop_orders o LEFT JOIN order_items i ON i.order_id = o.id GROUP BY o.id""",
    "user_order_counts": f"""
        SELECT u.id, count(o.id) AS order_count
        FROM users u LEFT JOIN (SELECT id, user_id FROM shop_orders WHERE {_VALID}) o
          ON o.user_id = u.id GROUP BY u.id""",
    "raw_product_ratings": """
        SELECT product_id, CAST(sum(rating) AS DOUBLE) / nullif(count(rating), 0) AS avg_rating,
               count(*) AS review_count FROM reviews GROUP BY product_id""",
    "low_stock_products": """
        SELECT id, name, sku, stock_quantity, category_id FROM products
        WHERE stock_quantity BETWEEN 1 AND 10""",
    "payments_made_by_user": """
        SELECT user_id, count(*) AS payments FROM shop_orders
        WHERE status IN ('paid', 'shipped', 'completed') AND user_id IS NOT NULL GROUP BY user_id""",
    "named_views": f"""
        SELECT t.id, t.total_sold, coalesce(r.mean, 0) AS avg_rating, coalesce(r.low, 0) AS low_rating
        FROM ({_SOLD.format(where="")}) t
        LEFT JOIN (SELECT product_id, CAST(sum(rating) AS DOUBLE) / nullif(count(rating), 0) AS mean,
                          count(*) FILTER (WHERE rating < 3) AS low
                   FROM reviews WHERE is_approved GROUP BY product_id) r ON r.product_id = t.id""",
    # ---- storefront and administration ----
    "catalog_listing": _CATALOG,
    "catalog_by_category": _CATALOG + " WHERE p.category_id = 7",
    "category_product_counts": """
        SELECT c.id, c.name, count(p.id) AS product_count
        FROM categories c LEFT JOIN products p ON p.category_id = c.id GROUP BY c.id, c.name""",
    "category_titles": """
        SELECT r.category_id, coalesce(c.name, 'All Products') AS title
        FROM (SELECT DISTINCT CASE WHEN p_size < 10 THEN p_partkey + 5000000
                                   ELSE CAST(substr(p_brand, 7) AS BIGINT) END AS category_id
              FROM part) r LEFT JOIN categories c ON c.id = r.category_id""",
    "categories_sorted": "SELECT id, name, slug FROM categories ORDER BY name, id",
    "product_slugs": """
        SELECT id, name, replace(lower(name), ' ', '-') AS name_slug FROM products""",
    "products_lookup": """
        SELECT id, name, price, stock_quantity FROM products
        WHERE id IN (SELECT product_id FROM order_items WHERE is_new)""",
    "admin_products": f"""
        SELECT p.id, p.name, '$' || {_MONEY.format('p.price')} AS price_label,
               coalesce(p.stock_quantity, 0) AS stock, coalesce(c.name, '-') AS category,
               p.is_featured, p.is_active
        FROM products p LEFT JOIN categories c ON c.id = p.category_id""",
    "admin_kpis": """
        SELECT (SELECT count(*) FROM products) AS total_products,
               (SELECT count(*) FROM users WHERE role = 'user') AS total_users,
               (SELECT count(*) FROM users WHERE role = 'user' AND is_premium) AS premium_users,
               (SELECT count(*) FROM shop_orders) AS total_orders,
               (SELECT count(*) FROM shop_orders WHERE status = 'pending') AS pending_orders,
               (SELECT CAST(coalesce(sum(total_amount), 0) AS DECIMAL(20,2))
                FROM shop_orders WHERE status IN ('paid', 'completed')) AS total_revenue""",
    "customers_list": f"""
        SELECT id, username, email, is_premium, is_active, {_DAY.format('created_at')} AS joined
        FROM users WHERE role = 'user'""",
    "coupons_list": f"""
        SELECT id, code, {_LABEL.format('discount_type')} AS type_label,
               CASE discount_type WHEN 'percentage' THEN CAST(discount_value AS VARCHAR) || '%'
                    ELSE '$' || {_MONEY.format('discount_value')} END AS value_label,
               '$' || {_MONEY.format('min_order_amount')} AS min_order_label,
               coalesce({_DAY.format('end_date')}, 'No expiry') AS expiry_label
        FROM coupons""",
    "recent_orders": _RECENT + "50",
    "recent_orders_by_month": _RECENT + "50",
    "recent_orders_top8": _RECENT + "8",
    "order_status_labels": f"""
        SELECT id, {_LABEL.format('status')} AS status_label, {_DAY.format('order_date')} AS day,
               coalesce(tracking_number, 'Not assigned') AS tracking FROM shop_orders""",
    # ---- carts and wishlists ----
    "cart_lines": """
        SELECT id, user_id, product_id, name, image_url, price, quantity, subtotal FROM priced_cart""",
    "cart_totals": """
        SELECT user_id, CAST(sum(quantity) AS BIGINT) AS cart_count,
               CAST(sum(subtotal) AS DECIMAL(20,2)) AS cart_total FROM priced_cart GROUP BY user_id""",
    "guest_cart_lines": """
        SELECT s.session_id, s.product_id, p.name, p.price, s.quantity,
               CAST(p.price * s.quantity AS DECIMAL(20,2)) AS subtotal
        FROM session_lines s JOIN products p ON p.id = s.product_id""",
    "guest_cart_totals": """
        SELECT s.session_id, CAST(sum(p.price * s.quantity) AS DECIMAL(20,2)) AS cart_total
        FROM session_lines s JOIN products p ON p.id = s.product_id GROUP BY s.session_id""",
    "guest_badges": """
        SELECT 'S' || event_id AS session_id,
               CASE WHEN event_id % 9 = 0 THEN 0 ELSE event_id % 5 + event_id % 3 + 3 END AS cart_count,
               CAST(3 AS BIGINT) AS wish_count
        FROM shop_events WHERE event_type = 'click'""",
    "guest_sessions_after_adds": """
        SELECT 'S' || e.event_id AS session_id, 4 AS wishes, l.pos,
               CASE WHEN l.pos = l.size THEN (e.k + 13) % 100 ELSE s.product_id END AS product_id,
               CASE WHEN l.pos = l.size THEN 2 ELSE s.quantity END AS quantity
        FROM shop_events e
        JOIN (VALUES (0, 0), (0, 3), (1, 3), (2, 3), (3, 3)) AS l(pos, size)
          ON l.size = CASE WHEN e.event_id % 9 = 0 THEN 0 ELSE 3 END
        LEFT JOIN session_lines s ON s.event_id = e.event_id AND s.pos = l.pos + 1
        WHERE e.event_type = 'click'""",
    "wishlist_items": """
        SELECT w.id AS wish_id, w.user_id, w.product_id, p.name, p.price, p.image_url, p.stock_quantity
        FROM wishlist w JOIN products p ON p.id = w.product_id""",
    "wishlist_counts": "SELECT user_id, count(*) AS wish_count FROM wishlist GROUP BY user_id",
    "account_summary": f"""
        SELECT u.id AS user_id, u.username,
               coalesce((SELECT CAST(sum(quantity) AS BIGINT) FROM priced_cart c
                         WHERE c.user_id = u.id), 0) AS cart_count,
               CAST(coalesce((SELECT sum(subtotal) FROM priced_cart c WHERE c.user_id = u.id), 0)
                    AS DECIMAL(20,2)) AS cart_total,
               (SELECT count(*) FROM wishlist w WHERE w.user_id = u.id) AS wish_count,
               (SELECT count(*) FROM shop_orders o WHERE o.user_id = u.id
                AND o.status IN ('paid', 'shipped', 'completed')) AS payments
        FROM users u WHERE u.role = 'user'""",
    "cart_after_adds": _upserted(
        "SELECT NULL, user_id, product_id, quantity, created_at, created_at FROM cart_adds"),
    "wishlist_after_adds": _wished("""
        SELECT user_id, k AS product_id, ts AS added_at FROM shop_events WHERE event_type = 'view'"""),
    "wishlist_move_cart": _upserted(
        "SELECT NULL, user_id, product_id, 1, created_at, created_at FROM moves"),
    "wishlist_move_remaining": """
        SELECT id, user_id, product_id, added_at FROM wishlist
        WHERE (user_id, product_id) NOT IN (SELECT (user_id, product_id) FROM moves)""",
    "cart_after_login_merge": _upserted("""
        SELECT NULL, user_id, product_id, greatest(1, quantity), logged_in_at, logged_in_at
        FROM session_lines WHERE user_id IS NOT NULL"""),
    "wishlist_after_login_merge": _wished("""
        SELECT user_id, product_id, logged_in_at AS added_at
        FROM session_wishes WHERE user_id IS NOT NULL"""),
    "cart_after_edits": f"""
        SELECT c.id, c.user_id, c.product_id, CAST(coalesce(e.quantity, c.quantity) AS INTEGER) AS quantity,
               CASE WHEN coalesce(e.quantity, c.quantity) IS DISTINCT FROM c.quantity
                    THEN {_AS_OF} ELSE c.updated_at END AS updated_at
        FROM cart_items c LEFT JOIN cart_edits e ON e.id = c.id AND e.user_id = c.user_id""",
    "cart_after_removals": """
        SELECT id, user_id, product_id, quantity FROM cart_items
        WHERE quantity > 3 OR product_id % 4 = 0""",
    "wishlist_after_removals": """
        SELECT id, user_id, product_id, added_at FROM wishlist WHERE id % 3 = 0""",
    # ---- checkout, orders and stock ----
    "checkout_quotes": """
        SELECT user_id, subtotal, tax_amount, shipping_amount, discount_amount, total_amount
        FROM quotes""",
    "placed_orders": f"""
        SELECT id, user_id, 'ORD-' || id AS order_number, total_amount, subtotal, tax_amount,
               shipping_amount, discount_amount, 'paid' AS status, 'paid' AS payment_status,
               payment_method, address AS shipping_address, address AS billing_address,
               {_AS_OF} AS order_date
        FROM placed""",
    "placed_order_items": """
        SELECT o.id AS order_id, c.product_id, c.quantity, c.price AS price_at_time,
               c.subtotal AS total_price
        FROM priced_cart c JOIN placed o ON o.user_id = c.user_id""",
    "cart_after_checkout": """
        SELECT id, user_id, product_id, quantity FROM cart_items
        WHERE user_id NOT IN (SELECT user_id FROM placed)""",
    "orders_after_replayed_batch": """
        SELECT id, user_id, 'ORD-' || id AS order_number, total_amount FROM (
            SELECT (SELECT greatest(max(id), 999) FROM shop_orders) + p.id - 999 AS id,
                   user_id, total_amount
            FROM placed p WHERE p.id < (SELECT max(id) FROM placed)
            UNION ALL
            SELECT (SELECT greatest(max(id), 999) FROM shop_orders) + (SELECT count(*) FROM placed)
                   + row_number() OVER (ORDER BY user_id), user_id, total_amount
            FROM quotes
            WHERE user_id % 2 = 1 AND user_id IN (
                SELECT c_custkey FROM customer WHERE c_mktsegment <> 'FURNITURE'))""",
    "order_id_assignment": """
        SELECT order_date, order_number,
               999 + row_number() OVER (ORDER BY order_date, order_number) AS id FROM shop_orders""",
    "stock_after_orders": f"""
        SELECT p.id, p.sku, CAST(p.stock_quantity - coalesce(m.units, 0) AS BIGINT) AS stock_quantity,
               CASE WHEN p.stock_quantity IS NOT NULL AND coalesce(m.units, 0) <> 0
                    THEN {_AS_OF} ELSE p.created_at END AS updated_at
        FROM products p
        LEFT JOIN (SELECT product_id, sum(quantity) AS units FROM order_items
                   WHERE is_new GROUP BY product_id) m ON m.product_id = p.id""",
    "variant_stock_after_orders": """
        SELECT v.id, v.product_id,
               CAST(v.stock_quantity - coalesce(m.units, 0) AS BIGINT) AS stock_quantity
        FROM product_variants v
        LEFT JOIN (SELECT variant_id, sum(quantity) AS units FROM order_items
                   WHERE is_new AND variant_id IS NOT NULL GROUP BY variant_id) m
          ON m.variant_id = v.id""",
    "orders_after_status_changes": f"""
        SELECT o.id, o.user_id, coalesce(c.last_status, o.status) AS status,
               CASE WHEN c.was_shipped AND u.id IS NOT NULL THEN {_TRACK.format('o.id')}
                    ELSE o.tracking_number END AS tracking_number,
               CASE WHEN c.last_status <> o.status OR c.was_shipped AND u.id IS NOT NULL
                         AND o.tracking_number IS DISTINCT FROM {_TRACK.format('o.id')}
                    THEN {_AS_OF} ELSE CAST(o.order_date AS TIMESTAMP) END AS updated_at
        FROM shop_orders o
        LEFT JOIN users u ON u.id = o.user_id
        LEFT JOIN (SELECT order_id, max_by(status, seq) AS last_status,
                          bool_or(status = 'shipped') AS was_shipped
                   FROM accepted_changes GROUP BY order_id) c ON c.order_id = o.id""",
    "status_notifications": f"""
        SELECT c.order_id, c.seq, o.order_number, u.username, u.email,
               'Order #' || o.order_number || ' Status Update' AS subject,
               upper(c.status) AS status_text,
               '$' || {_MONEY.format('o.total_amount')} AS total_label,
               CASE c.status
                   WHEN 'shipped' THEN 'Tracking Number: ' || {_TRACK.format('c.order_id')}
                        || '. {SHIPPED_LINE}'
                   WHEN 'paid' THEN {_quoted(STATUS_LINES['paid'])}
                   WHEN 'cancelled' THEN {_quoted(STATUS_LINES['cancelled'])}
                   WHEN 'completed' THEN {_quoted(STATUS_LINES['completed'])} END AS status_line
        FROM accepted_changes c
        JOIN shop_orders o ON o.id = c.order_id JOIN users u ON u.id = o.user_id""",
    # ---- bulk changes ----
    "append_products_defaults": f"""
        SELECT id, name, slug, price, compare_price, category_id, stock_quantity, sku, is_featured,
               is_active, views, created_at FROM products
        UNION ALL
        SELECT (SELECT greatest(100, max(id) + 1) FROM products) - 1 + row_number() OVER (ORDER BY id),
               name, replace(lower(name), ' ', '-'), price, NULL, category_id, 0, NULL,
               is_featured, true, 0, {_AS_OF}
        FROM product_feed WHERE reject_reason IS NULL""",
    "reviews_insert_ignore": """
        SELECT id, product_id, user_id, rating, title, is_approved, created_at, created_at AS updated_at
        FROM (SELECT *, 0 AS late FROM all_reviews WHERE event_type = 'view'
              UNION ALL
              SELECT *, 1 FROM all_reviews
              WHERE event_type = 'error' AND id % 23 <> 0 AND id % 19 <> 0)
        QUALIFY row_number() OVER (PARTITION BY product_id, user_id ORDER BY late, id) = 1""",
    "users_replace_into": f"""
        SELECT id, username, email, full_name, address, role, is_active, is_premium, created_at
        FROM users WHERE id NOT IN (SELECT id FROM displaced_users)
        UNION ALL
        SELECT id, username, email, 'Replaced', NULL, 'user', true, false, {_AS_OF}
        FROM replacements WHERE stays""",
    "orders_after_users_replaced": """
        SELECT id, CASE WHEN user_id NOT IN (SELECT id FROM displaced_users) THEN user_id END AS user_id
        FROM shop_orders""",
    "products_after_updates": f"""
        SELECT p.id, p.name, CASE WHEN u.k IS NULL THEN p.price
                                  ELSE CAST(u.value AS DECIMAL(10,2)) END AS price,
               CASE WHEN u.k IS NULL THEN p.description
                    WHEN u.event_id % 3 <> 0 THEN 'note ' || u.event_id END AS description,
               CASE WHEN u.k IS NULL THEN p.stock_quantity
                    ELSE CAST(u.event_id % 50 AS INTEGER) END AS stock_quantity,
               CASE WHEN u.k IS NOT NULL AND (
                         p.price IS DISTINCT FROM CAST(u.value AS DECIMAL(10,2))
                         OR p.description IS DISTINCT FROM
                            CASE WHEN u.event_id % 3 <> 0 THEN 'note ' || u.event_id END
                         OR p.stock_quantity IS DISTINCT FROM u.event_id % 50)
                    THEN {_AS_OF} ELSE p.created_at END AS updated_at
        FROM products p
        LEFT JOIN (SELECT * FROM shop_events WHERE event_type = 'purchase' AND event_id % 13 <> 0
                   QUALIFY row_number() OVER (PARTITION BY k ORDER BY event_id DESC) = 1) u
          ON u.k = p.id""",
    "products_after_toggles": f"""
        SELECT p.id,
               CASE WHEN t.k IS NULL THEN p.is_active WHEN t.event_id % 5 = 0 THEN false
                    ELSE t.event_id % 2 <> 0 END AS is_active,
               CASE WHEN t.k IS NULL THEN p.is_featured WHEN t.event_id % 5 = 0 THEN true
                    ELSE t.event_id % 2 <> 0 END AS is_featured,
               CASE WHEN t.event_id % 5 = 0 AND (p.is_active OR NOT p.is_featured)
                      OR t.event_id % 5 <> 0 AND (p.is_active <> (t.event_id % 2 <> 0)
                                                  OR p.is_featured <> (t.event_id % 2 <> 0))
                    THEN {_AS_OF} ELSE p.created_at END AS updated_at
        FROM products p
        LEFT JOIN (SELECT k, max(event_id) AS event_id FROM shop_events
                   WHERE event_type = 'error' GROUP BY k) t ON t.k = p.id""",
    "users_after_premium_toggles": f"""
        SELECT u.id, u.username,
               CASE WHEN t.user_id IS NULL THEN u.is_premium
                    ELSE t.event_id % 5 = 0 OR t.event_id % 2 <> 0 END AS is_premium,
               CASE WHEN t.user_id IS NOT NULL
                     AND (t.event_id % 5 = 0 OR t.event_id % 2 <> 0) IS DISTINCT FROM u.is_premium
                    THEN {_AS_OF} ELSE u.created_at END AS updated_at
        FROM users u
        LEFT JOIN (SELECT user_id, max(event_id) AS event_id FROM shop_events
                   WHERE event_type = 'view' GROUP BY user_id) t ON t.user_id = u.id""",
    "products_after_edits": f"""
        SELECT p.id, p.name, p.slug, p.description, p_brand AS short_description, p.price, p.compare_price,
               p.category_id, p.stock_quantity, p.image_url, p.is_featured, p.is_active,
               p.created_at AS updated_at
        FROM products p JOIN part ON p_partkey = p.id
        WHERE p.id NOT IN (SELECT id FROM product_forms)
        UNION ALL
        SELECT f.id, f.name, f.slug, f.name, CASE WHEN f.id % 2 = 0 THEN upper(f.name) END, f.price,
               CAST(f.price + 1 AS DECIMAL(10,2)), f.category_id, CAST(f.id % 100 AS INTEGER),
               'new/' || f.id, f.is_featured, f.id % 3 <> 0, {_AS_OF}
        FROM product_forms f""",
    "categories_after_edits": """
        SELECT c.id, coalesce(f.name, c.name) AS name, coalesce(f.slug, c.slug) AS slug, c.parent_id
        FROM categories c
        LEFT JOIN category_forms f ON f.id = c.id""",
    "categories_after_slug_handovers": """
        SELECT c.id, c.name,
               CASE WHEN c.id <= 1000 THEN c.slug
                    WHEN c.id % 2 = 1 AND b.id IS NOT NULL THEN b.slug
                    WHEN c.id % 2 = 1 THEN 'moved-' || c.id
                    WHEN a.id IS NOT NULL THEN 'moved-' || a.id
                    ELSE 'moved-' || (c.id + 1) END AS slug
        FROM categories c LEFT JOIN categories a ON a.id = c.id + 1 AND c.id > 1000
        LEFT JOIN categories b ON b.id = c.id - 1 AND b.id > 1000""",
    "products_after_category_delete": """
        SELECT id, name, CASE WHEN category_id NOT IN (SELECT id FROM deleted_categories)
                              THEN category_id END AS category_id
        FROM products""",
    "categories_after_category_delete": """
        SELECT id, name, CASE WHEN parent_id NOT IN (SELECT id FROM deleted_categories)
                              THEN parent_id END AS parent_id
        FROM categories WHERE id NOT IN (SELECT id FROM deleted_categories)""",
    "order_items_after_product_delete": f"""
        SELECT {_ITEMS} FROM order_items
        WHERE product_id NOT IN (SELECT p_partkey FROM part WHERE p_size >= 45)""",
    "order_items_after_variant_delete": """
        SELECT order_id, product_id, CASE WHEN variant_id % 3 <> 2 THEN variant_id END AS variant_id,
               quantity, price_at_time, total_price FROM order_items""",
    "order_items_after_order_delete": f"""
        SELECT {_ITEMS} FROM order_items
        WHERE order_id NOT IN (SELECT id FROM shop_orders WHERE status = 'cancelled')""",
    "users_after_delete": """
        SELECT id, username, role FROM users WHERE id NOT IN (SELECT id FROM deleted_users)""",
    "orders_after_user_delete": """
        SELECT id, order_number,
               CASE WHEN user_id NOT IN (SELECT id FROM deleted_users) THEN user_id END AS user_id
        FROM shop_orders""",
    "reviews_after_user_delete": """
        SELECT id, product_id, user_id FROM reviews
        WHERE user_id NOT IN (SELECT id FROM deleted_users)""",
    "wishlist_after_user_delete": """
        SELECT id, user_id, product_id, added_at FROM wishlist
        WHERE user_id NOT IN (SELECT id FROM deleted_users)""",
    "users_with_premium": "SELECT id, username, false AS is_premium FROM users",
    "coupons_seed_dates": """
        SELECT id, code, DATE '2024-02-01' + valid_days AS end_date FROM coupon_feed
        WHERE reject_reason IS NULL""",
    # ---- feed checks and integrity ----
    "product_feed_validated": """
        SELECT id, name, price, category_id, is_featured, replace(lower(name), ' ', '-') AS slug,
               reject_reason FROM product_feed""",
    "product_edits_validated": """
        SELECT id, coalesce(reject_reason, CASE WHEN id <= 0 THEN 'id' END) AS reject_reason
        FROM product_feed""",
    "coupon_feed_validated": """
        SELECT id, code, discount_type, discount_value, valid_days, reject_reason FROM coupon_feed""",
    "category_feed_validated": """
        SELECT id, name, replace(lower(name), ' ', '-') AS slug,
               CASE WHEN coalesce(name, '') IN ('', '0') THEN 'name' WHEN id <= 0 THEN 'id'
               END AS reject_reason
        FROM category_feed""",
    "status_changes_validated": """
        SELECT order_id, seq, status,
               CASE WHEN status IN ('refunded', 'bogus') THEN 'status' END AS reject_reason
        FROM status_changes""",
    "registrations_validated": "SELECT seq, username, email, reject_reason FROM registrations",
    "registration_conflicts": """
        SELECT r.seq, r.username, r.email,
               CASE WHEN EXISTS (SELECT 1 FROM users u WHERE lower(u.username) = lower(r.username))
                    THEN 'username'
                    WHEN EXISTS (SELECT 1 FROM users u WHERE lower(u.email) = lower(r.email))
                    THEN 'email' END AS conflict
        FROM registrations r WHERE r.reject_reason IS NULL""",
    "users_after_registrations": f"""
        SELECT id, username, email, full_name, role, is_active, is_premium, created_at FROM users
        UNION ALL
        SELECT (SELECT greatest(100, max(id) + 1) FROM users) - 1 + row_number() OVER (ORDER BY seq),
               username, email, NULL, 'user', true, false, {_AS_OF}
        FROM registrations r
        WHERE reject_reason IS NULL
          AND NOT EXISTS (SELECT 1 FROM users u WHERE lower(u.username) = lower(r.username))
          AND NOT EXISTS (SELECT 1 FROM users u WHERE lower(u.email) = lower(r.email))
          AND seq = (SELECT min(seq) FROM registrations o
                     WHERE o.username = r.username AND o.reject_reason IS NULL)""",
    "products_after_additions": """
        SELECT id, name, slug, price, category_id, stock_quantity, is_featured, is_active FROM products
        UNION ALL
        SELECT (SELECT greatest(100, max(id) + 1) FROM products) - 1 + row_number() OVER (ORDER BY id),
               name, slug, price, category_id, 0, is_featured, true
        FROM (SELECT *, replace(lower(name), ' ', '-') AS slug FROM product_feed
              WHERE reject_reason IS NULL
                AND (category_id IS NULL OR category_id IN (SELECT id FROM categories))
              QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY id) = 1)
        WHERE slug NOT IN (SELECT slug FROM products)""",
    "categories_after_additions": """
        SELECT id, name, slug, parent_id, true AS is_active FROM categories
        UNION ALL
        SELECT (SELECT max(id) FROM categories) + row_number() OVER (ORDER BY id),
               name, replace(lower(name), ' ', '-'), NULL, true
        FROM (SELECT name, min(id) AS id FROM category_feed WHERE name NOT IN ('', '0') GROUP BY name)""",
    "coupons_after_additions": """
        SELECT id, code, discount_type, discount_value, min_order_amount, end_date,
               CAST(NULL AS INTEGER) AS usage_limit, CAST(NULL AS INTEGER) AS used_count FROM coupons
        UNION ALL
        SELECT (SELECT max(id) FROM coupons) + row_number() OVER (ORDER BY id),
               code, discount_type, discount_value,
               CAST(CASE WHEN valid_days > 40 THEN valid_days * 2.5 ELSE 0 END AS DECIMAL(10,2)),
               DATE '2024-02-01' + valid_days, 1, 0
        FROM (SELECT * FROM coupon_feed WHERE reject_reason IS NULL
                AND discount_type IN ('percentage', 'fixed')
              QUALIFY row_number() OVER (PARTITION BY code ORDER BY id) = 1)
        WHERE code NOT IN (SELECT code FROM coupons)""",
    "categories_after_seeding": """
        SELECT id, name, slug, parent_id FROM categories
        UNION ALL SELECT 900, 'Gadgets', 'gadgets', NULL
        WHERE 'gadgets' NOT IN (SELECT slug FROM categories)
        UNION ALL SELECT 901, 'Asia', 'asia', NULL
        WHERE 'asia' NOT IN (SELECT slug FROM categories)""",
    "dq_duplicate_keys": _duplicates([
        ("users", "username", "lower(username)", "raw_users"),
        ("users", "email", "lower(email)", "raw_users"),
        ("categories", "slug", "slug", "raw_categories"),
        ("products", "slug", "slug", "raw_products"),
        ("products", "sku", "sku", "raw_products"),
        ("product_variants", "sku", "sku", "product_variants"),
        ("orders", "order_number", "'ORD-' || o_custkey", "orders"),
        ("reviews", "product_id,user_id", "product_id || '|' || user_id",
         "(SELECT * FROM raw_pairs)"),
        ("cart_items", "user_id,product_id", "user_id || '|' || product_id",
         "(SELECT * FROM raw_pairs)"),
        ("wishlist", "user_id,product_id", "user_id || '|' || product_id",
         "(SELECT * FROM raw_pairs WHERE event_type = 'signup')"),
        ("coupons", "code", "lower(code)", "coupon_feed"),
    ]),
    "dq_orphans": _orphans([
        ("categories", "parent_id", "(SELECT * FROM categories WHERE parent_id IS DISTINCT FROM 103)",
         _LEFT_CATEGORIES),
        ("products", "category_id", "(SELECT * FROM products WHERE id IN (" + _LEFT_PRODUCTS + "))",
         _LEFT_CATEGORIES),
        ("product_variants", "product_id",
         "(SELECT * FROM product_variants WHERE variant_value <> 'Large')", _LEFT_PRODUCTS),
        ("orders", "user_id", "(SELECT * FROM shop_orders WHERE status <> 'cancelled')",
         "SELECT id FROM users WHERE id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"),
        ("order_items", "order_id", "order_items", _LEFT_ORDERS),
        ("order_items", "product_id", "order_items", _LEFT_PRODUCTS),
        ("order_items", "variant_id", "order_items", _LEFT_VARIANTS),
        ("reviews", "product_id", "reviews", _LEFT_PRODUCTS),
        ("reviews", "user_id", "reviews", _LEFT_USERS),
        ("cart_items", "product_id", "cart_items", _LEFT_PRODUCTS),
        ("cart_items", "user_id", "cart_items", _LEFT_USERS),
        ("wishlist", "user_id", "wishlist", _LEFT_USERS),
        ("wishlist", "product_id", "wishlist", _LEFT_PRODUCTS),
    ]),
    "dq_domain": """
        SELECT 'users' AS table_name, 'role' AS column_name, role AS value, count(*) AS n
        FROM raw_users WHERE role NOT IN ('user', 'admin') GROUP BY role
        UNION ALL
        SELECT 'orders', 'status', o_orderstatus, count(*) FROM orders
        WHERE o_orderstatus <> 'F' GROUP BY o_orderstatus
        UNION ALL
        SELECT 'orders', 'payment_status', lower(o_orderpriority), count(*) FROM orders
        GROUP BY lower(o_orderpriority)
        UNION ALL
        SELECT 'coupons', 'discount_type', discount_type, count(*) FROM coupon_feed
        WHERE discount_type = 'gift' GROUP BY discount_type
        UNION ALL
        SELECT 'reviews', 'rating', CAST(event_id % 7 AS VARCHAR), count(*) FROM raw_pairs
        WHERE event_id % 29 <> 0 AND event_id % 7 IN (0, 6) GROUP BY event_id % 7""",
    "dq_not_null": _nulls([
        ("users", "username", "username", "raw_users"), ("users", "email", "email", "raw_users"),
        ("categories", "name", "name", "raw_categories"),
        ("categories", "slug", "slug", "raw_categories"),
        ("products", "name", "name", "raw_products"), ("products", "slug", "slug", "raw_products"),
        ("products", "price", "price", "raw_products"),
        ("product_variants", "product_id", "product_id", "product_variants"),
        ("product_variants", "variant_name", "variant_name", "product_variants"),
        ("product_variants", "variant_value", "variant_value", "product_variants"),
        ("orders", "order_number", "o_custkey", "orders"),
        ("orders", "total_amount", "o_totalprice", "orders"),
        ("orders", "subtotal", "nullif(o_orderpriority, '1-URGENT')", "orders"),
        ("order_items", "order_id", "order_id", "order_items"),
        ("order_items", "product_id", "product_id", "order_items"),
        ("order_items", "quantity", "nullif(quantity, 50)", "order_items"),
        ("order_items", "price_at_time", "price_at_time", "order_items"),
        ("order_items", "total_price", "total_price", "order_items"),
        ("reviews", "product_id", "product_id", "raw_pairs"),
        ("reviews", "user_id", "user_id", "raw_pairs"),
        ("cart_items", "user_id", "user_id", "raw_pairs"),
        ("cart_items", "product_id", "product_id", "raw_pairs"),
        ("cart_items", "quantity", "event_id", "raw_pairs"),
        ("wishlist", "user_id", "user_id", "(SELECT * FROM raw_pairs WHERE event_type = 'signup')"),
        ("wishlist", "product_id", "product_id",
         "(SELECT * FROM raw_pairs WHERE event_type = 'signup')"),
        ("coupons", "code", "code", "coupon_feed"),
        ("coupons", "discount_value", "discount_value", "coupon_feed"),
    ]),
}
# the stream must leave the same stock as the batch ledger
_BODIES["stock_stream"] = _BODIES["stock_after_orders"]
# routines called from SQL give what the reports give
for _report in ("order_totals", "user_order_counts", "low_stock_products", "monthly_sales_report"):
    _BODIES[f"sql_{_report}"] = _BODIES[_report]

ORACLES = {name: with_tables(body) for name, body in _BODIES.items()}
