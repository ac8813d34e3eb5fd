"""The shop's tables and feeds as common table expressions.

Each entry is the body of one expression; names it mentions in NEEDS order are
put in front of a query by ``with_tables``.
"""

import re

_STATUSES = ("['pending','processing','paid','shipped','delivered','completed',"
             "'cancelled','refunded'{more}]")
_EMAIL_OF = "lower(c_name) || '@example.com'"

TABLES = {
    "shop_events": """
        SELECT event_id, ts, user_id, event_type, value,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
        FROM events""",
    "categories": """
        SELECT CAST(r_regionkey + 101 AS BIGINT) AS id, r_name AS name,
               CAST(NULL AS BIGINT) AS parent_id,
               replace(lower(r_name), ' ', '-') AS slug
        FROM region
        UNION ALL
        SELECT n_nationkey + 1, n_name, n_regionkey + 101, replace(lower(n_name), ' ', '-')
        FROM nation
        UNION ALL
        SELECT s_suppkey + 1001, s_name, s_nationkey + 1, replace(lower(s_name), ' ', '-')
        FROM supplier""",
    "products": """
        SELECT p_partkey AS id, p_name AS name,
               replace(lower(p_name), ' ', '-') || '-' || p_partkey AS slug,
               CASE WHEN p_size <> 4
                    THEN p_name || ' by ' || p_brand || '. ' || repeat(p_name || ' ', p_size)
               END AS description,
               CAST(p_retailprice AS DECIMAL(10,2)) AS price,
               CAST(CAST(p_retailprice AS DECIMAL(10,2)) + p_size AS DECIMAL(10,2)) AS compare_price,
               CASE WHEN p_size <> 50 THEN CAST(substr(p_brand, 7) AS BIGINT) END AS category_id,
               CASE WHEN p_size <> 1 THEN greatest(p_size - 6, 0) END AS stock_quantity,
               'SKU-' || p_partkey AS sku,
               CASE p_type WHEN 'SMALL' THEN '  '
                           WHEN 'LARGE' THEN ' ' || chr(9) || 'img/' || p_partkey || '.jpg' || chr(10)
                           WHEN 'ECONOMY' THEN NULL
                           ELSE 'img/' || p_partkey || '.jpg' END AS image_url,
               p_type = 'PROMO' AS is_featured, p_size <> 7 AS is_active, p_size * 3 AS views,
               TIMESTAMP '2024-01-01 00:00:00' AS created_at
        FROM part""",
    "product_variants": """
        SELECT p_partkey * 3 + i AS id, p_partkey AS product_id, 'Size' AS variant_name,
               ['Small', 'Medium', 'Large'][i + 1] AS variant_value,
               p_size + i AS stock_quantity, 'SKU-' || p_partkey || '-' || i AS sku
        FROM part, range(3) AS sizes(i)""",
    "users": f"""
        SELECT c_custkey AS id, c_name AS username, {_EMAIL_OF} AS email, c_name AS full_name,
               CASE WHEN c_nationkey >= 5 THEN 'Street ' || c_custkey END AS address,
               CASE WHEN c_nationkey = 0 THEN 'admin' ELSE 'user' END AS role,
               c_acctbal >= 0 AS is_active,
               CAST(DATE '2020-01-01' + CAST(c_custkey % 1000 AS INTEGER) AS TIMESTAMP) AS created_at,
               c_acctbal > 9000 AS is_premium
        FROM customer""",
    "shop_orders": f"""
        SELECT o_orderkey AS id, CASE WHEN o_orderkey % 41 <> 0 THEN o_custkey END AS user_id,
               'ORD-' || o_orderkey AS order_number,
               CASE WHEN o_orderkey % 8 IN (3, 4, 5)
                    THEN 'TRK' || (100000 + o_orderkey * 7919 % 900000) END AS tracking_number,
               CAST(o_totalprice AS DECIMAL(20,2)) AS total_amount,
               CAST(o_orderkey % 900 AS DECIMAL(20,2)) AS tax_amount,
               CAST(10 * (o_orderkey % 2) AS DECIMAL(20,2)) AS shipping_amount,
               {_STATUSES.format(more='')}[o_orderkey % 8 + 1] AS status,
               ['pending','paid','failed','refunded'][o_orderkey % 4 + 1] AS payment_status,
               o_orderdate AS order_date
        FROM orders""",
    "order_items": """
        SELECT l_orderkey AS order_id, l_partkey AS product_id,
               CASE WHEN l_linenumber % 2 = 0 THEN l_partkey * 3 + l_linenumber % 3 END AS variant_id,
               CAST(l_quantity AS INTEGER) AS quantity,
               CAST(l_extendedprice AS DECIMAL(10,2)) AS price_at_time,
               CAST(CAST(l_extendedprice AS DECIMAL(10,2)) * CAST(l_quantity AS INTEGER)
                    AS DECIMAL(20,2)) AS total_price,
               l_linestatus = 'O' AS is_new
        FROM lineitem""",
    "all_reviews": """
        SELECT event_id AS id, k AS product_id, user_id,
               CASE WHEN event_id % 29 <> 0 THEN CAST(event_id % 5 + 1 AS INTEGER) END AS rating,
               'Review ' || event_id AS title, event_id % 3 <> 0 AS is_approved, ts AS created_at,
               event_type
        FROM shop_events WHERE event_type IN ('view', 'error')""",
    "reviews": """
        SELECT * FROM all_reviews
        QUALIFY row_number() OVER (PARTITION BY product_id, user_id ORDER BY id) = 1""",
    "cart_items": """
        SELECT user_id * 1000 + k AS id, user_id, k AS product_id,
               CAST(sum(event_id % 5 + 1) AS INTEGER) AS quantity,
               min(ts) AS created_at, max(ts) AS updated_at
        FROM shop_events WHERE event_type = 'click' GROUP BY user_id, k""",
    "wishlist": """
        SELECT min(event_id) AS id, user_id, k AS product_id, min(ts) AS added_at
        FROM shop_events WHERE event_type = 'signup' GROUP BY user_id, k""",
    "coupons": """
        SELECT s_suppkey AS id, 'SAVE' || s_suppkey AS code,
               CASE WHEN s_nationkey < 12 THEN 'percentage' ELSE 'fixed' END AS discount_type,
               CAST(s_suppkey % 50 + 1 AS DECIMAL(10,2)) AS discount_value,
               CAST(greatest(s_acctbal, 0) AS DECIMAL(10,2)) AS min_order_amount,
               CASE WHEN s_acctbal >= 1000 THEN DATE '2024-01-01' + s_nationkey END AS end_date
        FROM supplier""",
    # session carts, already one row per line
    "session_lines": """
        SELECT 'S' || event_id AS session_id, event_id,
               CASE WHEN value >= 5 THEN user_id END AS user_id, ts AS logged_in_at,
               pos, [k, (k + 7) % 100, -1 - k][pos] AS product_id,
               CAST([event_id % 5, event_id % 3 + 1, 2][pos] AS INTEGER) AS quantity
        FROM shop_events, (VALUES (1), (2), (3)) AS lines(pos)
        WHERE event_type = 'click' AND event_id % 9 <> 0""",
    "session_wishes": """
        SELECT 'S' || event_id AS session_id, CASE WHEN value >= 5 THEN user_id END AS user_id,
               ts AS logged_in_at, CASE i WHEN 1 THEN k ELSE (k + 13) % 100 END AS product_id
        FROM shop_events, (VALUES (1), (2)) AS wishes(i) WHERE event_type = 'click'""",
    "cart_adds": r"""
        SELECT user_id, k AS product_id, ts AS created_at,
               greatest(1, coalesce(CAST(trunc(TRY_CAST(nullif(regexp_extract(raw,
                   '^[ \t\n\r]*([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?)', 1), '')
                   AS DOUBLE)) AS BIGINT), 0)) AS quantity
        FROM (SELECT *, CASE WHEN event_id % 97 = 0 THEN '3000000000' WHEN event_id % 2 = 0
                             THEN ['x', '3abc', '-4', ' 2.9', '1e1'][event_id % 5 + 1]
                             ELSE CAST(event_id % 7 AS VARCHAR) END AS raw
              FROM shop_events WHERE event_type = 'purchase')
        WHERE quantity <= 2147483647""",
    "moves": """
        SELECT user_id, k AS product_id, ts AS created_at FROM shop_events
        WHERE event_type = 'purchase'""",
    "status_changes": f"""
        SELECT o_orderkey AS order_id, 1 AS seq,
               {_STATUSES.format(more=",'bogus'")}[o_orderkey % 9 + 1] AS status
        FROM orders WHERE o_orderstatus IN ('O', 'P')
        UNION ALL
        SELECT o_orderkey, 2, {_STATUSES.format(more=",'bogus'")}[o_orderkey // 9 % 9 + 1]
        FROM orders WHERE o_orderstatus = 'P'""",
    "accepted_changes": """
        SELECT * FROM status_changes WHERE status NOT IN ('refunded', 'bogus')""",
    "deleted_users": """
        SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0 AND c_nationkey <> 0""",
    "deleted_categories": "SELECT id FROM categories WHERE parent_id = 103",
    "product_feed": """
        SELECT p_partkey AS id,
               CASE p_size WHEN 1 THEN '' WHEN 2 THEN '0' WHEN 3 THEN NULL ELSE p_name END AS name,
               CAST(CASE p_size WHEN 5 THEN 0 WHEN 6 THEN -p_retailprice WHEN 7 THEN NULL
                                ELSE p_retailprice END AS DECIMAL(10,2)) AS price,
               CASE WHEN p_size < 40 THEN CAST(substr(p_brand, 7) AS BIGINT) END AS category_id,
               CASE WHEN p_type <> 'SMALL' THEN p_type = 'PROMO' END AS is_featured,
               CASE WHEN p_size IN (1, 2, 3) THEN 'name' WHEN p_size IN (5, 6, 7) THEN 'price'
               END AS reject_reason
        FROM part""",
    "category_forms": """
        SELECT * FROM (SELECT id + 1001 AS id, name, replace(lower(name), ' ', '-') AS slug
                       FROM category_feed
                       WHERE name NOT IN ('', '0') AND id + 1001 IN (SELECT id FROM categories)) f
        WHERE NOT EXISTS (SELECT 1 FROM categories o WHERE o.slug = f.slug AND o.id <> f.id)
        QUALIFY row_number() OVER (PARTITION BY slug ORDER BY id) = 1""",
    "product_forms": """
        SELECT * FROM (SELECT *, replace(lower(name), ' ', '-') AS slug FROM product_feed
                       WHERE reject_reason IS NULL AND id > 0 AND id IN (SELECT id FROM products)) f
        WHERE NOT EXISTS (SELECT 1 FROM products o WHERE o.slug = f.slug AND o.id <> f.id)
        QUALIFY row_number() OVER (PARTITION BY slug ORDER BY id) = 1""",
    "coupon_feed": """
        SELECT s_suppkey AS id,
               CASE WHEN s_nationkey = 0 THEN '' WHEN s_nationkey = 1 THEN '0'
                    WHEN s_nationkey < 8 THEN 'SAVE' || s_suppkey
                    ELSE 'SAVE-' || s_suppkey // 3 END AS code,
               CASE WHEN s_nationkey < 12 THEN 'percentage' WHEN s_nationkey < 20 THEN 'fixed'
                    ELSE 'gift' END AS discount_type,
               CAST(s_acctbal AS DECIMAL(10,2)) AS discount_value, s_nationkey + 30 AS valid_days,
               CASE WHEN s_nationkey < 2 THEN 'code'
                    WHEN CAST(s_acctbal AS DECIMAL(10,2)) <= 0 THEN 'discount_value'
               END AS reject_reason
        FROM supplier""",
    "category_feed": """
        SELECT s_suppkey AS id,
               CASE s_nationkey WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN '0' WHEN 3 THEN 'Shared Shelf'
                                ELSE 'Home & ' || s_name END AS name
        FROM supplier""",
    "registrations": f"""
        SELECT c_custkey AS seq,
               CASE c_nationkey WHEN 0 THEN upper(c_name) WHEN 7 THEN 'shared ' || c_custkey // 50
                    ELSE 'new ' || c_custkey END AS username,
               CASE c_nationkey WHEN 1 THEN upper({_EMAIL_OF}) WHEN 2 THEN 'no-at-sign'
                    WHEN 3 THEN 'spaced' || c_custkey || '@example.com'
                    WHEN 4 THEN '' WHEN 5 THEN '' WHEN 6 THEN 'a..b@example.com'
                    ELSE 'new' || c_custkey || '@example.org' END AS email,
               CASE WHEN c_nationkey IN (2, 4, 5, 6) THEN 'email' END AS reject_reason
        FROM customer""",
    "replacements": f"""
        SELECT *, seq = max(seq) OVER (PARTITION BY id)
                  AND seq = max(seq) OVER (PARTITION BY lower(username))
                  AND seq = max(seq) OVER (PARTITION BY lower(email)) AS stays
        FROM (
            SELECT c_custkey AS seq,
                   CASE WHEN c_nationkey % 5 IN (0, 3) THEN c_custkey
                        ELSE c_custkey + 10000000 END AS id,
                   CASE c_nationkey % 5 WHEN 1 THEN upper(c_name)
                        WHEN 3 THEN 'Customer#' || lpad(CAST(c_custkey + 1 AS VARCHAR), 9, '0')
                        WHEN 4 THEN 'dup' || c_custkey // 100 ELSE 'rep' || c_custkey END AS username,
                   CASE WHEN c_nationkey % 5 = 2 THEN {_EMAIL_OF}
                        ELSE 'rep' || c_custkey || '@example.org' END AS email
            FROM customer WHERE c_mktsegment = 'BUILDING')""",
    "displaced_users": """
        SELECT u.id FROM users u
        WHERE u.id IN (SELECT id FROM replacements)
           OR lower(u.username) IN (SELECT lower(username) FROM replacements)
           OR lower(u.email) IN (SELECT lower(email) FROM replacements)""",
    "priced_cart": """
        SELECT c.id, c.user_id, c.product_id, p.name, p.image_url, p.price, c.quantity,
               CAST(p.price * c.quantity AS DECIMAL(20,2)) AS subtotal
        FROM cart_items c JOIN products p ON p.id = c.product_id""",
    "quotes": """
        SELECT user_id, subtotal,
               CAST(subtotal * 0.10 AS DECIMAL(20,2)) AS tax_amount,
               CAST(fee AS DECIMAL(20,2)) AS shipping_amount,
               CAST(0 AS DECIMAL(20,2)) AS discount_amount,
               CAST(subtotal * 1.10 + fee AS DECIMAL(20,2)) AS total_amount
        FROM (SELECT user_id, CAST(sum(subtotal) AS DECIMAL(20,2)) AS subtotal,
                     CASE WHEN sum(subtotal) <= 100 THEN 10 ELSE 0 END AS fee
              FROM priced_cart GROUP BY user_id)""",
    # the one request of each user that orders the cart
    "paying": """
        SELECT c_custkey AS user_id,
               CASE WHEN c_nationkey <= 20 THEN 'Street ' || c_custkey
                    ELSE 'No address provided' END AS address,
               CASE WHEN c_nationkey = 0 THEN c_custkey * 10 + 1 ELSE c_custkey * 10 END AS request_id,
               CASE WHEN c_nationkey = 0 THEN 'debit_card' WHEN c_nationkey >= 5 THEN 'paypal'
                    ELSE 'credit_card' END AS payment_method
        FROM customer
        WHERE c_mktsegment NOT IN ('FURNITURE', 'AUTOMOBILE')
          AND (c_nationkey <> 0 OR c_mktsegment = 'BUILDING')""",
    "placed": """
        SELECT 999 + row_number() OVER (ORDER BY p.request_id) AS id, q.*, p.payment_method, p.address
        FROM quotes q JOIN paying p ON p.user_id = q.user_id""",
    "cart_edits": """
        SELECT id, CASE WHEN product_id % 4 = 0 THEN user_id + 1 ELSE user_id END AS user_id,
               CASE WHEN quantity > 5 THEN 12 ELSE greatest(1, product_id % 3) END AS quantity
        FROM cart_items""",
    "raw_pairs": """
        SELECT CASE WHEN k <> 99 THEN k END AS product_id, user_id, event_id, event_type
        FROM shop_events""",
    "raw_users": """
        SELECT username, email, role FROM users
        UNION ALL
        SELECT username, raw_email, CASE WHEN seq % 7 = 0 THEN 'guest' ELSE 'user' END
        FROM (SELECT r.*, CASE c.c_nationkey
                          WHEN 3 THEN '  ' || r.email || chr(9) WHEN 5 THEN NULL
                          ELSE r.email END AS raw_email
              FROM registrations r JOIN customer c ON c.c_custkey = r.seq)""",
    "raw_products": """
        SELECT name, replace(lower(name), ' ', '-') AS slug, price,
               'SKU-' || category_id AS sku FROM product_feed""",
    "raw_categories": """
        SELECT name, slug FROM categories
        UNION ALL SELECT name, replace(lower(name), ' ', '-') FROM category_feed""",
}


def with_tables(body: str) -> str:
    """Put the tables a query mentions, and those they mention, in front of it."""
    needed = []

    def visit(text):
        for name in TABLES:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                visit(TABLES[name])
                needed.append(name)

    visit(body)
    ctes = ",\n".join(f"{name} AS ({TABLES[name]})" for name in needed)
    return f"WITH {ctes}\n{body}" if needed else body
