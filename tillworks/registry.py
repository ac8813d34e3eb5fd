"""Every query by name, over the shop derived from a folder of star-schema files."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillworks.operators import changes, ids, inserts, integrity, lookups, validation
from tillworks.plans import (administration, carts, catalog, checkout, fulfilment, maintained, reports,
                             routines, stock)
from tillworks.schemas import ID_FLOORS, UNIQUE_KEYS
from tillworks.session import cut_lineage, scratch_path, tune
from tillworks.sources import sessions
from tillworks.sources.star import AS_OF, StarShop
from tillworks.sources.tables import read_orders_by_month, seed_rows, write_table
from tillworks.streaming import stock_stream

REPORT_YEAR, REPORT_MONTH = 1998, 10
LOW_STOCK = 10
LISTED_CATEGORY = 7
QUERIES = {}


def query(name):
    def register(build):
        QUERIES[name] = build
        return build
    return register


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES[name](StarShop(tune(spark), folder))


# ---- reports ----

@query("top_selling_products")
def _(s):
    return reports.top_selling_products(s.products, s.order_items)


@query("top_selling_products_valid")
def _(s):
    return reports.top_selling_products_valid(s.products, s.order_items, s.orders)


@query("product_ratings")
def _(s):
    return reports.product_ratings(s.products, s.reviews)


@query("order_summary")
def _(s):
    return reports.order_summary(s.orders, s.users, s.order_items)


@query("monthly_sales_report")
def _(s):
    return reports.monthly_sales_report(s.orders, REPORT_YEAR, REPORT_MONTH)


@query("order_totals")
def _(s):
    return reports.order_totals(s.orders, s.order_items)


@query("user_order_counts")
def _(s):
    return reports.user_order_counts(s.users, s.orders)


@query("raw_product_ratings")
def _(s):
    return reports.raw_product_ratings(s.reviews)


@query("low_stock_products")
def _(s):
    return reports.low_stock_products(s.products, LOW_STOCK)


@query("payments_made_by_user")
def _(s):
    return reports.payments_made(s.orders)


@query("named_views")
def _(s):
    reports.register_views(s.products, s.users, s.orders, s.order_items, s.reviews)
    return s.spark.sql("""
        SELECT t.id, t.total_sold, r.avg_rating, r.low_rating
        FROM top_selling_products t JOIN product_ratings r ON t.id = r.id""")


# ---- reports kept up to date from feeds ----

def _ratings_state(s):
    """Stored reviews, then added ones, some rated anew, and those of deleted users gone."""
    measures = maintained.rating_measures()
    fks = [("product_id", s.products, "id"), ("user_id", s.users, "id")]
    state = maintained.state_of(maintained.approved(s.stored_reviews), "product_id", measures)
    added = cut_lineage(inserts.accepted_rows(
        s.stored_reviews, s.review_feed, UNIQUE_KEYS["reviews"], "id", fks).select(
        *s.stored_reviews.columns))
    reviews = s.stored_reviews.unionByName(added)
    old = reviews.where("id % 5 = 0")
    new = old.withColumn("rating", F.lit(5).cast("int"))
    gone = changes.deletable_users(s.user_deletions).select(F.col("id").alias("user_id")).distinct()
    lost = reviews.where("id % 5 <> 0").unionByName(new).join(gone, "user_id", "left_semi").select(
        *reviews.columns)
    for feed in (maintained.signed(added, 1), maintained.replaced(old, new),
                 maintained.signed(lost, -1)):
        state = cut_lineage(maintained.refreshed(
            state, maintained.approved(feed), "product_id", measures))
    return state


@query("product_ratings_kept")
def _(s):
    return maintained.product_ratings(s.products, _ratings_state(s))


def _items_state(s):
    """Items of most orders, then those of the others, then all of deleted products gone."""
    measures, late = maintained.item_measures(), F.col("order_id") % 10 == 0
    state = maintained.state_of(s.order_items.where(~late), "order_id", measures)
    state = cut_lineage(maintained.refreshed(
        state, maintained.signed(s.order_items.where(late), 1), "order_id", measures))
    gone = s.deleted_products.select(F.col("id").alias("product_id")).distinct()
    lost = s.order_items.join(gone, "product_id", "left_semi").select(*s.order_items.columns)
    return maintained.refreshed(state, maintained.signed(lost, -1), "order_id", measures)


@query("order_totals_kept")
def _(s):
    return maintained.order_totals(s.orders, _items_state(s))


@query("order_summary_kept")
def _(s):
    return maintained.order_summary(s.orders, s.users, _items_state(s))


# ---- storefront and administration ----

@query("catalog_listing")
def _(s):
    return catalog.catalog_listing(s.products, s.categories, s.reviews)


@query("catalog_by_category")
def _(s):
    return catalog.catalog_listing(s.products, s.categories, s.reviews, LISTED_CATEGORY)


@query("category_product_counts")
def _(s):
    return catalog.category_product_counts(s.categories, s.products)


@query("category_titles")
def _(s):
    return lookups.category_titles(s.requested_categories, s.categories)


@query("categories_sorted")
def _(s):
    return catalog.categories_sorted(s.categories)


@query("product_slugs")
def _(s):
    return catalog.product_slugs(s.products)


@query("products_lookup")
def _(s):
    return lookups.lookup(s.products.select("id", "name", "price", "stock_quantity"),
                          s.new_order_items.select(F.col("product_id").alias("id")))


@query("admin_products")
def _(s):
    return catalog.admin_products(s.products, s.categories)


@query("admin_kpis")
def _(s):
    return catalog.admin_kpis(s.products, s.users, s.orders)


@query("customers_list")
def _(s):
    return catalog.customers_list(s.users)


@query("coupons_list")
def _(s):
    return catalog.coupons_list(s.coupons)


@query("recent_orders")
def _(s):
    return catalog.recent_orders(s.orders, s.users, 50)


@query("recent_orders_top8")
def _(s):
    return catalog.recent_orders(s.orders, s.users, 8)


@query("recent_orders_by_month")
def _(s):
    root = scratch_path(s.spark, "months")
    write_table(changes.conform(s.orders, "orders"), root, "orders")
    return catalog.recent_orders_by_month(read_orders_by_month(s.spark, root), s.users, 50)


@query("order_status_labels")
def _(s):
    return catalog.order_status_labels(s.orders)


# ---- carts and wishlists ----

@query("cart_lines")
def _(s):
    return carts.cart_lines(s.cart_items, s.products)


@query("cart_totals")
def _(s):
    return carts.cart_totals(s.cart_items, s.products)


@query("guest_cart_lines")
def _(s):
    return carts.guest_cart_lines(s.guest_sessions, s.products)


@query("guest_cart_totals")
def _(s):
    return carts.guest_cart_totals(s.guest_sessions, s.products)


@query("guest_badges")
def _(s):
    return carts.guest_badges(s.guest_sessions)


@query("guest_sessions_after_adds")
def _(s):
    product = F.element_at("wishlist", 2)
    return (
        s.guest_sessions.select(
            "session_id", sessions.add_to_guest_cart(F.col("cart"), product, F.lit(2)).alias("cart"),
            sessions.add_to_guest_wishlist(F.col("wishlist"), (product + 1) % 100).alias("wishlist"))
        .select("session_id", F.size("wishlist").alias("wishes"), F.posexplode("cart").alias("pos", "line"))
        .select("session_id", "wishes", "pos", "line.product_id", "line.quantity"))


@query("wishlist_items")
def _(s):
    return carts.wishlist_items(s.wishlist, s.products)


@query("wishlist_counts")
def _(s):
    return carts.wishlist_counts(s.wishlist)


@query("account_summary")
def _(s):
    return carts.account_summary(s.users, s.cart_items, s.products, s.wishlist, s.orders)


@query("cart_after_adds")
def _(s):
    return carts.cart_upsert(s.cart_items, s.cart_adds, s.products, s.users).drop("variant_id")


@query("wishlist_after_adds")
def _(s):
    return carts.wishlist_add(s.wishlist, s.wishlist_adds, s.products, s.users)


@query("wishlist_move_cart")
def _(s):
    return carts.cart_with_moves(s.cart_items, s.wishlist_moves, s.products, s.users).drop(
        "variant_id")


@query("wishlist_move_remaining")
def _(s):
    return changes.delete_keys(s.wishlist, s.wishlist_moves, carts.CART_KEY)


@query("cart_after_login_merge")
def _(s):
    return carts.merge_guest_carts(s.guest_sessions, s.cart_items, s.products, s.users).drop(
        "variant_id")


@query("wishlist_after_login_merge")
def _(s):
    return carts.merge_guest_wishlists(s.guest_sessions, s.wishlist, s.products, s.users)


@query("cart_after_edits")
def _(s):
    return carts.set_cart_quantities(s.cart_items, s.cart_edits, AS_OF).select(
        "id", "user_id", "product_id", "quantity", "updated_at")


@query("cart_after_removals")
def _(s):
    return changes.delete_keys(s.cart_items, s.cart_removals, ["id", "user_id"]).select(
        "id", "user_id", "product_id", "quantity")


@query("wishlist_after_removals")
def _(s):
    wrong_owner = F.when(F.col("id") % 3 == 0, F.col("user_id") + 1).otherwise(F.col("user_id"))
    removals = s.wishlist.select("id", wrong_owner.alias("user_id"))
    return changes.delete_keys(s.wishlist, removals, ["id", "user_id"])


# ---- checkout, orders and stock ----

def _place(s):
    return checkout.place_orders(s.cart_items, s.products, s.checkout_requests, AS_OF)


@query("checkout_quotes")
def _(s):
    return checkout.checkout_quotes(s.cart_items, s.products)


@query("placed_orders")
def _(s):
    return _place(s)[0]


@query("placed_order_items")
def _(s):
    return _place(s)[1].drop("variant_id")


@query("cart_after_checkout")
def _(s):
    return _place(s)[2].select("id", "user_id", "product_id", "quantity")


@query("orders_after_replayed_batch")
def _(s):
    """Place all requests, delete the newest order, fill the carts again, and deliver the same
    requests once more together with new ones of every second user: the new orders."""
    shop = {"products": s.products, "cart_items": s.cart_items,
            "orders": changes.conform(s.orders, "orders"),
            "order_items": changes.conform(s.order_items, "order_items"),
            "placed_requests": s.spark.createDataFrame([], checkout.LEDGER),
            "id_counters": ids.no_counters(s.spark)}
    stored = ids.next_id(s.orders, ID_FLOORS["orders"])
    shop |= checkout.place_orders_once(shop, s.checkout_requests, AS_OF)
    newest = shop["orders"].agg(F.max("id").alias("id"))
    shop |= changes.cascade_delete(
        {n: shop[n] for n in ("orders", "order_items")}, "orders", newest)
    more = s.checkout_requests.where("user_id % 2 = 1").select("user_id").distinct().select(
        (F.col("user_id") + 10**12).alias("request_id"), "user_id", F.lit("New").alias("card_name"),
        F.lit(None).cast("string").alias("payment_method"),
        F.lit(None).cast("string").alias("address"))
    shop["cart_items"] = s.cart_items
    after = checkout.place_orders_once(
        shop, s.checkout_requests.unionByName(more, allowMissingColumns=True), AS_OF)
    return after["orders"].where(F.col("id") >= stored).select(
        "id", "user_id", "order_number", "total_amount")


@query("order_id_assignment")
def _(s):
    return ids.assign_ids(s.orders.select("order_date", "order_number"),
                          ["order_date", "order_number"], ID_FLOORS["orders"])


@query("stock_after_orders")
def _(s):
    return stock.stock_after_orders(s.products, s.new_order_items, AS_OF).select(
        "id", "sku", "stock_quantity", "updated_at")


@query("variant_stock_after_orders")
def _(s):
    return stock.variant_stock_after_orders(s.product_variants, s.new_order_items).select(
        "id", "product_id", "stock_quantity")


@query("stock_stream")
def _(s):
    """Feed the open lines to the stream as files and return stock after it."""
    base = scratch_path(s.spark, "stock-stream")
    s.new_order_items.write.parquet(f"{base}/items")
    stock_stream.start_stock_stream(
        s.spark, f"{base}/items", f"{base}/movements", f"{base}/checkpoint").awaitTermination()
    left = stock_stream.current_stock(
        s.spark, s.products, f"{base}/movements", "product", as_of=AS_OF)
    return left.select("id", "sku", "stock_quantity", "updated_at")


@query("orders_after_status_changes")
def _(s):
    return fulfilment.apply_status_changes(s.orders, s.users, s.status_changes, AS_OF).select(
        "id", "user_id", "status", "tracking_number", "updated_at")


@query("status_notifications")
def _(s):
    return fulfilment.status_notifications(s.orders, s.users, s.status_changes)


# ---- bulk changes ----

@query("append_products_defaults")
def _(s):
    valid = validation.accepted(validation.validate_products(s.product_feed))
    start = ids.next_id(s.products, ID_FLOORS["products"])
    rows = ids.assign_ids(valid.withColumnRenamed("id", "_source"), ["_source"], start).drop("_source")
    return changes.append_with_defaults(s.products, rows, "products", AS_OF).select(
        "id", "name", "slug", "price", "compare_price", "category_id", "stock_quantity", "sku",
        "is_featured", "is_active", "views", "created_at")


@query("reviews_insert_ignore")
def _(s):
    return inserts.insert_ignore(
        s.stored_reviews, s.review_feed, UNIQUE_KEYS["reviews"], "id",
        [("product_id", s.products, "id"), ("user_id", s.users, "id")]).drop("comment")


def _replaced(s):
    rows = s.user_replacements
    full = changes.append_with_defaults(
        s.users.withColumn("seq", F.lit(None).cast("bigint")).limit(0), rows, "users", AS_OF)
    return inserts.replace_into(s.users, full, [["id"]] + UNIQUE_KEYS["users"], "seq")


@query("users_replace_into")
def _(s):
    return _replaced(s)[0].select("id", "username", "email", "full_name", "address", "role",
                                  "is_active", "is_premium", "created_at")


@query("orders_after_users_replaced")
def _(s):
    """Orders once the replaced users' deletion has reached them."""
    return changes.null_out(s.orders.select("id", "user_id"), "user_id", _replaced(s)[1])


@query("products_after_updates")
def _(s):
    return changes.apply_updates(
        s.products, s.product_updates, "id", "seq", ["price", "description", "stock_quantity"],
        AS_OF).select("id", "name", "price", "description", "stock_quantity", "updated_at")


@query("products_after_toggles")
def _(s):
    return changes.apply_toggles(
        s.products, s.product_toggles, ["is_active", "is_featured"], as_of=AS_OF
    ).select("id", "is_active", "is_featured", "updated_at")


@query("users_after_premium_toggles")
def _(s):
    return changes.apply_toggles(s.users, s.user_toggles, "is_premium", as_of=AS_OF).select(
        "id", "username", "is_premium", "updated_at")


@query("products_after_edits")
def _(s):
    forms = s.product_feed.withColumns({
        "seq": F.col("id"), "compare_price": F.col("price") + 1, "description": F.col("name"),
        "short_description": F.when(F.col("id") % 2 == 0, F.upper("name")),
        "stock_quantity": (F.col("id") % 100).cast("int"),
        "image_url": F.concat(F.lit("new/"), F.col("id").cast("string")),
        "is_active": F.col("id") % 3 != 0})
    return administration.edit_products(s.products, forms, AS_OF).select(
        "id", *administration.PRODUCT_FORM, "updated_at")


@query("categories_after_edits")
def _(s):
    forms = s.category_feed.select((F.col("id") + 1001).alias("id"), "name",
                                   F.col("id").alias("seq"))
    return administration.edit_categories(s.categories, forms, AS_OF).select(
        "id", "name", "slug", "parent_id")


@query("categories_after_slug_handovers")
def _(s):
    """Neighbours hand their slugs over within one feed: odd ids make room, even ids take the
    slug of the id above, odd ids what these gave up, and even ids what those gave up."""
    own = s.categories.where("id > 1000").select("id", "slug")
    above = own.select((F.col("id") - 1).alias("id"), F.col("slug").alias("next"))
    below = own.select((F.col("id") + 1).alias("id"), F.col("slug").alias("last"))
    near = own.join(above, "id", "left").join(below, "id", "left")
    odd, moved = F.col("id") % 2 == 1, F.lit("moved-")
    wishes = F.array(F.when(odd, F.concat(moved, F.col("id").cast("string"))),
                     F.when(~odd, F.col("next")), F.when(odd, F.col("last")),
                     F.when(~odd, F.concat(moved, (F.col("id") + 1).cast("string"))))
    edits = near.select("id", F.posexplode(wishes).alias("turn", "slug")).where(
        "slug is not null").withColumn("seq", F.col("turn") * F.lit(1 << 40) + F.col("id"))
    kept = inserts.holding_edits(s.categories, edits, ["slug"], "seq")
    return changes.apply_updates(s.categories, kept, "id", "seq", "slug").select("id", "name", "slug")


@query("products_after_category_delete")
def _(s):
    out = changes.cascade_delete(
        {"categories": s.categories, "products": s.products}, "categories", s.deleted_categories)
    return out["products"].select("id", "name", "category_id")


@query("categories_after_category_delete")
def _(s):
    out = changes.cascade_delete({"categories": s.categories}, "categories", s.deleted_categories)
    return out["categories"].select("id", "name", "parent_id")


@query("order_items_after_product_delete")
def _(s):
    out = changes.cascade_delete(
        {"products": s.products, "product_variants": s.product_variants,
         "order_items": s.order_items}, "products", s.deleted_products)
    return out["order_items"]


@query("order_items_after_variant_delete")
def _(s):
    large = s.product_variants.where(F.col("variant_value") == "Large").select("id")
    out = changes.cascade_delete(
        {"product_variants": s.product_variants, "order_items": s.order_items},
        "product_variants", large)
    return out["order_items"]


@query("order_items_after_order_delete")
def _(s):
    cancelled = s.orders.where(F.col("status") == "cancelled").select("id")
    out = changes.cascade_delete({"orders": s.orders, "order_items": s.order_items},
                                 "orders", cancelled)
    return out["order_items"]


def _without_users(s, **tables):
    gone = changes.deletable_users(s.user_deletions)
    return changes.cascade_delete({"users": s.users, **tables}, "users", gone)


@query("users_after_delete")
def _(s):
    return _without_users(s)["users"].select("id", "username", "role")


@query("orders_after_user_delete")
def _(s):
    return _without_users(s, orders=s.orders)["orders"].select("id", "order_number", "user_id")


@query("reviews_after_user_delete")
def _(s):
    return _without_users(s, reviews=s.reviews)["reviews"].select("id", "product_id", "user_id")


@query("wishlist_after_user_delete")
def _(s):
    return _without_users(s, wishlist=s.wishlist)["wishlist"]


@query("users_with_premium")
def _(s):
    before = s.users.drop("is_premium")
    return changes.ensure_column(before, "is_premium", False).select("id", "username", "is_premium")


@query("coupons_seed_dates")
def _(s):
    """Accepted coupons with an end date counted from the reference day."""
    good = validation.accepted(validation.validate_coupons(s.coupon_feed))
    ends = F.date_add(F.to_date(changes.at(AS_OF)), F.col("valid_days"))
    return good.select("id", "code", ends.alias("end_date"))


# ---- feed checks and integrity ----

@query("product_feed_validated")
def _(s):
    return validation.validate_products(s.product_feed)


@query("product_edits_validated")
def _(s):
    return validation.validate_products(s.product_feed, editing=True).select("id", "reject_reason")


@query("coupon_feed_validated")
def _(s):
    return validation.validate_coupons(s.coupon_feed)


@query("category_feed_validated")
def _(s):
    return validation.validate_categories(s.category_feed, editing=True)


@query("status_changes_validated")
def _(s):
    return validation.validate_status_changes(s.status_changes)


@query("registrations_validated")
def _(s):
    return validation.validate_registrations(s.registration_feed)


@query("registration_conflicts")
def _(s):
    good = validation.accepted(validation.validate_registrations(s.registration_feed))
    return lookups.registration_conflicts(good, s.users)


@query("users_after_registrations")
def _(s):
    """Registrations that passed both checks, appended with ids and defaults."""
    return administration.register_users(s.users, s.registration_feed, AS_OF).select(
        "id", "username", "email", "full_name", "role", "is_active", "is_premium", "created_at")


@query("products_after_additions")
def _(s):
    feed = s.product_feed.withColumnRenamed("id", "seq")
    return administration.add_products(s.products, feed, AS_OF, s.categories).select(
        "id", "name", "slug", "price", "category_id", "stock_quantity", "is_featured", "is_active")


@query("categories_after_additions")
def _(s):
    feed = s.category_feed.withColumnRenamed("id", "seq")
    return administration.add_categories(s.categories, feed, AS_OF).select(
        "id", "name", "slug", "parent_id", "is_active")


@query("coupons_after_additions")
def _(s):
    """All five fields of the form, with an end date counted from the reference day."""
    ends = F.date_add(F.to_date(changes.at(AS_OF)), F.col("valid_days"))
    least = F.when(F.col("valid_days") > 40, F.col("valid_days") * 2.5).cast("decimal(10,2)")
    feed = s.coupon_feed.withColumnRenamed("id", "seq").withColumns(
        {"end_date": ends, "min_order_amount": F.coalesce(least, F.lit(0).cast("decimal(10,2)"))}
    ).drop("valid_days")
    stored = changes.conform(s.coupons, "coupons")
    return administration.add_coupons(stored, feed, AS_OF).select(
        "id", "code", "discount_type", "discount_value", "min_order_amount", "end_date",
        "usage_limit", "used_count")


@query("categories_after_seeding")
def _(s):
    """A few literal categories put into the table, unless their slug is there."""
    seeds = seed_rows(s.spark, "categories", [
        dict(id=900, name="Gadgets", slug="gadgets"), dict(id=901, name="Asia", slug="asia"),
        dict(id=902, name="Gadgets again", slug="gadgets")])
    stored = changes.conform(s.categories, "categories")
    return inserts.insert_ignore(stored, seeds, UNIQUE_KEYS["categories"], "id").select(
        "id", "name", "slug", "parent_id")


@query("dq_duplicate_keys")
def _(s):
    return integrity.duplicate_key_report(s.unchecked)


@query("dq_orphans")
def _(s):
    return integrity.orphan_report(s.after_bare_deletes)


@query("dq_domain")
def _(s):
    return integrity.domain_report(s.unchecked)


@query("dq_not_null")
def _(s):
    return integrity.null_report(s.unchecked)


# ---- the stored routines, called from SQL ----

def _sql(s, text):
    routines.register_tables(
        {"users": s.users, **{t: getattr(s, t) for t in routines.ROUTINE_TABLES}})
    routines.register_routines(s.spark)
    return s.spark.sql(text)


@query("sql_order_totals")
def _(s):
    return _sql(s, "SELECT id, calculate_order_total(id) AS order_total FROM shop_orders")


@query("sql_user_order_counts")
def _(s):
    return _sql(s, "SELECT id, get_user_order_count(id) AS order_count FROM shop_users")


@query("sql_low_stock_products")
def _(s):
    return _sql(s, f"SELECT * FROM get_low_stock_products({LOW_STOCK})")


@query("sql_monthly_sales_report")
def _(s):
    return _sql(s, f"SELECT * FROM get_monthly_sales_report({REPORT_YEAR}, {REPORT_MONTH})")
