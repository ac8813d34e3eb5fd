"""The shop's tables and change feeds derived from star-schema order data.

Input are the Parquet tables region, nation, supplier, part, customer, orders,
lineitem and events. Values are built from keys and attributes with integer
arithmetic, text and two-digit decimals only, so that SQL elsewhere can derive
the very same rows. Every table is derived from its whole source; feeds select by
attributes of the data, such as open line items or overdrawn customers.
"""

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tillworks.functions.columns import slugify, tracking_code
from tillworks.schemas import GUEST_SESSIONS, MONEY, MONEY_SUM, ORDER_STATUSES, PAYMENT_STATUSES

_STAR = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
}
OPENING_DAY = "2024-01-01 00:00:00"
AS_OF = "2024-02-01 00:00:00"
NEW_USER_IDS = 10_000_000
CART_TYPE = GUEST_SESSIONS["cart"].dataType
SIZES = ["Small", "Medium", "Large"]


def _moment(text) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _null(dtype) -> Column:
    return F.lit(None).cast(dtype)


def _text(c) -> Column:
    return F.col(c).cast("string")


def _element(values, position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (position + 1).cast("int"))


class StarShop:
    """Shop tables and feeds over one folder of star-schema files, all lazy."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def star(self, name: str) -> DataFrame:
        return self.spark.read.schema(_STAR[name]).parquet(f"{self.folder}/{name}.parquet")

    def _events(self, *kinds: str) -> DataFrame:
        product = F.get_json_object("props", "$.k").cast("bigint")
        return (self.star("events").where(F.col("event_type").isin(*kinds))
                .select("event_id", "ts", "user_id", "value", product.alias("k")))

    # ---- tables ----

    @cached_property
    def categories(self) -> DataFrame:
        """Three levels: regions, nations, suppliers. Products hang on nations."""
        def level(df, key, first, name, parent):
            return df.select((F.col(key) + first).cast("bigint").alias("id"),
                             F.col(name).alias("name"), parent.cast("bigint").alias("parent_id"))
        tree = (
            level(self.star("region"), "r_regionkey", 101, "r_name", F.lit(None))
            .unionByName(level(self.star("nation"), "n_nationkey", 1, "n_name",
                               F.col("n_regionkey") + 101))
            .unionByName(level(self.star("supplier"), "s_suppkey", 1001, "s_name",
                               F.col("s_nationkey") + 1)))
        return tree.select(
            "id", "name", slugify("name").alias("slug"), _null("string").alias("description"),
            "parent_id", _null("string").alias("image_url"), F.lit(True).alias("is_active"),
            _moment(OPENING_DAY).alias("created_at"))

    @cached_property
    def products(self) -> DataFrame:
        size, price = F.col("p_size"), F.col("p_retailprice").cast(MONEY)
        words = F.concat(F.col("p_name"), F.lit(" by "), F.col("p_brand"), F.lit(". "),
                         F.repeat(F.concat(F.col("p_name"), F.lit(" ")), size))
        image = F.concat(F.lit("img/"), _text("p_partkey"), F.lit(".jpg"))
        return self.star("part").select(
            F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
            F.concat(slugify("p_name"), F.lit("-"), _text("p_partkey")).alias("slug"),
            F.when(size != 4, words).alias("description"),
            F.col("p_brand").alias("short_description"),
            price.alias("price"), (price + size).cast(MONEY).alias("compare_price"),
            F.when(size != 50, F.substring("p_brand", 7, 9).cast("bigint")).alias("category_id"),
            F.when(size != 1, F.greatest(size - 6, F.lit(0))).alias("stock_quantity"),
            F.concat(F.lit("SKU-"), _text("p_partkey")).alias("sku"),
            F.when(F.col("p_type") == "SMALL", "  ")
            .when(F.col("p_type") == "LARGE", F.concat(F.lit(" \t"), image, F.lit("\n")))
            .when(F.col("p_type") != "ECONOMY", image).alias("image_url"),
            _null("string").alias("gallery_images"),
            (F.col("p_type") == "PROMO").alias("is_featured"), (size != 7).alias("is_active"),
            (size * 3).alias("views"), _moment(OPENING_DAY).alias("created_at"),
            _moment(OPENING_DAY).alias("updated_at"))

    @cached_property
    def product_variants(self) -> DataFrame:
        """Three sizes of every product."""
        i = F.col("i")
        return (
            self.star("part")
            .withColumn("i", F.explode(F.array(*[F.lit(n) for n in range(len(SIZES))])))
            .select((F.col("p_partkey") * 3 + i).alias("id"),
                    F.col("p_partkey").alias("product_id"), F.lit("Size").alias("variant_name"),
                    _element(SIZES, i).alias("variant_value"),
                    F.lit(0).cast(MONEY).alias("additional_price"),
                    (F.col("p_size") + i).alias("stock_quantity"),
                    F.concat(F.lit("SKU-"), _text("p_partkey"), F.lit("-"),
                             i.cast("string")).alias("sku"),
                    _null("string").alias("image_url")))

    @cached_property
    def users(self) -> DataFrame:
        joined = F.date_add(F.lit("2020-01-01").cast("date"),
                            (F.col("c_custkey") % 1000).cast("int")).cast("timestamp_ntz")
        return self.star("customer").select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("username"),
            F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
            F.col("c_name").alias("full_name"), _null("string").alias("phone"),
            F.when(F.col("c_nationkey") >= 5,
                   F.concat(F.lit("Street "), _text("c_custkey"))).alias("address"),
            F.when(F.col("c_nationkey") == 0, "admin").otherwise("user").alias("role"),
            (F.col("c_acctbal") >= 0).alias("is_active"),
            _null("timestamp_ntz").alias("last_login"), joined.alias("created_at"),
            joined.alias("updated_at"), (F.col("c_acctbal") > 9000).alias("is_premium"))

    @cached_property
    def orders(self) -> DataFrame:
        key = F.col("o_orderkey")
        total = F.col("o_totalprice").cast(MONEY_SUM)
        tax = (key % 900).cast(MONEY_SUM)
        fee = F.when(key % 2 == 1, F.lit(10)).otherwise(F.lit(0)).cast(MONEY_SUM)
        status = _element(ORDER_STATUSES, key % len(ORDER_STATUSES))
        return self.star("orders").select(
            key.alias("id"), F.when(key % 41 != 0, F.col("o_custkey")).alias("user_id"),
            F.concat(F.lit("ORD-"), _text("o_orderkey")).alias("order_number"),
            F.when(status.isin("shipped", "delivered", "completed"),
                   tracking_code(key)).alias("tracking_number"),
            total.alias("total_amount"), (total - tax - fee).cast(MONEY_SUM).alias("subtotal"),
            tax.alias("tax_amount"), fee.alias("shipping_amount"),
            F.lit(0).cast(MONEY_SUM).alias("discount_amount"), status.alias("status"),
            _element(PAYMENT_STATUSES, key % len(PAYMENT_STATUSES)).alias("payment_status"),
            F.lit("credit_card").alias("payment_method"),
            _null("string").alias("shipping_address"), _null("string").alias("billing_address"),
            _null("string").alias("notes"), F.col("o_orderdate").alias("order_date"),
            F.col("o_orderdate").alias("updated_at"))

    def _items(self, lines: DataFrame) -> DataFrame:
        price, quantity = F.col("l_extendedprice").cast(MONEY), F.col("l_quantity").cast("int")
        return lines.select(
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
            F.when(F.col("l_linenumber") % 2 == 0,
                   F.col("l_partkey") * 3 + F.col("l_linenumber") % 3).alias("variant_id"),
            quantity.alias("quantity"), price.alias("price_at_time"),
            (price * quantity).cast(MONEY_SUM).alias("total_price"))

    @cached_property
    def order_items(self) -> DataFrame:
        return self._items(self.star("lineitem"))

    @cached_property
    def new_order_items(self) -> DataFrame:
        """The lines still open, taken as just inserted."""
        return self._items(self.star("lineitem").where(F.col("l_linestatus") == "O"))

    @staticmethod
    def _as_reviews(events: DataFrame) -> DataFrame:
        e = F.col("event_id")
        return events.select(
            e.alias("id"), F.col("k").alias("product_id"), "user_id",
            F.when(e % 29 != 0, (e % 5 + 1).cast("int")).alias("rating"),
            F.concat(F.lit("Review "), _text("event_id")).alias("title"),
            _null("string").alias("comment"), (e % 3 != 0).alias("is_approved"),
            F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"))

    def _first_reviews(self, *kinds) -> DataFrame:
        first = self._events(*kinds).groupBy("k", "user_id").agg(
            F.min_by("ts", "event_id").alias("ts"), F.min("event_id").alias("event_id"))
        return self._as_reviews(first)

    @cached_property
    def reviews(self) -> DataFrame:
        """One review per product and user, the earliest one."""
        return self._first_reviews("view", "error")

    @cached_property
    def stored_reviews(self) -> DataFrame:
        return self._first_reviews("view")

    @cached_property
    def review_feed(self) -> DataFrame:
        """Incoming reviews, some of unknown products or users."""
        return self._as_reviews(self._events("error")).withColumns({
            "product_id": F.when(F.col("id") % 23 == 0, -1 - F.col("product_id"))
            .otherwise(F.col("product_id")),
            "user_id": F.when(F.col("id") % 19 == 0, -1 - F.col("user_id"))
            .otherwise(F.col("user_id"))})

    @cached_property
    def cart_items(self) -> DataFrame:
        return (
            self._events("click").groupBy("user_id", F.col("k").alias("product_id"))
            .agg(F.sum(F.col("event_id") % 5 + 1).cast("int").alias("quantity"),
                 F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))
            .select((F.col("user_id") * 1000 + F.col("product_id")).alias("id"), "user_id",
                    "product_id", _null("bigint").alias("variant_id"), "quantity",
                    "created_at", "updated_at"))

    @cached_property
    def wishlist(self) -> DataFrame:
        return (self._events("signup").groupBy("user_id", F.col("k").alias("product_id"))
                .agg(F.min("event_id").alias("id"), F.min("ts").alias("added_at"))
                .select("id", "user_id", "product_id", "added_at"))

    @cached_property
    def coupons(self) -> DataFrame:
        ends = F.date_add(F.lit(OPENING_DAY[:10]).cast("date"), F.col("s_nationkey"))
        return self.star("supplier").select(
            F.col("s_suppkey").alias("id"),
            F.concat(F.lit("SAVE"), _text("s_suppkey")).alias("code"),
            F.when(F.col("s_nationkey") < 12, "percentage").otherwise("fixed").alias("discount_type"),
            (F.col("s_suppkey") % 50 + 1).cast(MONEY).alias("discount_value"),
            F.greatest(F.col("s_acctbal"), F.lit(0.0)).cast(MONEY).alias("min_order_amount"),
            F.when(F.col("s_acctbal") >= 1000, ends).alias("end_date"))

    @cached_property
    def guest_sessions(self) -> DataFrame:
        """One session per click: up to three cart lines, one of them of a
        product that does not exist, and a wishlist with a repetition."""
        e, k = F.col("event_id"), F.col("k")

        def line(product, quantity):
            return F.struct(product.cast("bigint").alias("product_id"),
                            quantity.cast("int").alias("quantity"))

        full = F.array(line(k, e % 5), line((k + 7) % 100, e % 3 + 1), line(-1 - k, F.lit(2)))
        empty = F.array().cast(CART_TYPE)
        return self._events("click").select(
            F.concat(F.lit("S"), _text("event_id")).alias("session_id"),
            F.when(F.col("value") >= 5, F.col("user_id")).alias("user_id"),
            F.when(e % 9 == 0, empty).otherwise(full).alias("cart"),
            F.array(k, (k + 13) % 100, k).alias("wishlist"), F.col("ts").alias("logged_in_at"))

    # ---- change feeds ----

    @cached_property
    def cart_adds(self) -> DataFrame:
        """Adds with quantities as typed into a form, some too large to be stored."""
        raw = _element(["x", "3abc", "-4", " 2.9", "1e1"], F.col("event_id") % 5)
        return self._events("purchase").select(
            "user_id", F.col("k").alias("product_id"),
            F.when(F.col("event_id") % 97 == 0, "3000000000").when(F.col("event_id") % 2 == 0, raw)
            .otherwise((F.col("event_id") % 7).cast("string")).alias("quantity"),
            F.col("ts").alias("created_at"))

    @cached_property
    def wishlist_adds(self) -> DataFrame:
        return self._events("view").select(
            "user_id", F.col("k").alias("product_id"), F.col("ts").alias("added_at"))

    @cached_property
    def wishlist_moves(self) -> DataFrame:
        return self._events("purchase").select(
            "user_id", F.col("k").alias("product_id"), F.col("ts").alias("created_at"))

    @cached_property
    def product_updates(self) -> DataFrame:
        e, k = F.col("event_id"), F.col("k")
        return self._events("purchase").select(
            F.when(e % 13 == 0, -1 - k).otherwise(k).alias("id"), e.alias("seq"),
            F.col("value").cast(MONEY).alias("price"),
            F.when(e % 3 != 0, F.concat(F.lit("note "), _text("event_id"))).alias("description"),
            (e % 50).cast("int").alias("stock_quantity"))

    def _toggles(self, kind: str, target: Column) -> DataFrame:
        e = F.col("event_id")
        return self._events(kind).select(
            target.alias("id"), e.alias("seq"), F.when(e % 5 != 0, e % 2 == 0).alias("current"))

    @cached_property
    def product_toggles(self) -> DataFrame:
        return self._toggles("error", F.col("k"))

    @cached_property
    def user_toggles(self) -> DataFrame:
        return self._toggles("view", F.col("user_id"))

    @cached_property
    def status_changes(self) -> DataFrame:
        """One change for open orders, two for those in progress; some are bogus."""
        wanted = ORDER_STATUSES + ["bogus"]
        key = F.col("o_orderkey")

        def change(seq, position):
            return F.struct(F.lit(seq).alias("seq"), _element(wanted, position).alias("status"))

        both = F.array(change(1, key % 9), change(2, F.floor(key / 9) % 9))
        return (
            self.star("orders").where(F.col("o_orderstatus").isin("O", "P"))
            .select(key.alias("order_id"), "o_orderstatus", F.explode(both).alias("c"))
            .where((F.col("c.seq") == 1) | (F.col("o_orderstatus") == "P"))
            .select("order_id", "c.seq", "c.status"))

    @cached_property
    def deleted_products(self) -> DataFrame:
        return self.star("part").where(F.col("p_size") >= 45).select(F.col("p_partkey").alias("id"))

    @cached_property
    def deleted_categories(self) -> DataFrame:
        return (self.categories.where(F.col("parent_id") == 103).select("id"))

    @cached_property
    def user_deletions(self) -> DataFrame:
        """Delete requests for overdrawn users; some administrators name themselves."""
        return self.star("customer").where(F.col("c_acctbal") < 0).select(
            F.when(F.col("c_nationkey") == 0, F.col("c_custkey")).otherwise(F.lit(-1))
            .alias("admin_id"), F.col("c_custkey").alias("user_id"))

    @cached_property
    def product_feed(self) -> DataFrame:
        size, price = F.col("p_size"), F.col("p_retailprice").cast(MONEY)
        return self.star("part").select(
            F.col("p_partkey").alias("id"),
            F.when(size == 1, "").when(size == 2, "0").when(size != 3, F.col("p_name")).alias("name"),
            F.when(size == 5, F.lit(0).cast(MONEY)).when(size == 6, -price)
            .when(size != 7, price).alias("price"),
            F.when(size < 40, F.substring("p_brand", 7, 9).cast("bigint")).alias("category_id"),
            F.when(F.col("p_type") != "SMALL", F.col("p_type") == "PROMO").alias("is_featured"))

    @cached_property
    def coupon_feed(self) -> DataFrame:
        nation = F.col("s_nationkey")
        return self.star("supplier").select(
            F.col("s_suppkey").alias("id"),
            F.when(nation == 0, "").when(nation == 1, "0")
            .when(nation < 8, F.concat(F.lit("save"), _text("s_suppkey")))
            .otherwise(F.concat(F.lit("save-"), F.floor(F.col("s_suppkey") / 3).cast("string")))
            .alias("code"),
            F.when(nation < 12, "percentage").when(nation < 20, "fixed").otherwise("gift")
            .alias("discount_type"),
            F.col("s_acctbal").cast(MONEY).alias("discount_value"),
            (nation + 30).alias("valid_days"))

    @cached_property
    def category_feed(self) -> DataFrame:
        nation = F.col("s_nationkey")
        return self.star("supplier").select(
            F.col("s_suppkey").alias("id"),
            F.when(nation == 0, "").when(nation == 2, "0")
            .when(nation == 3, "Shared Shelf")
            .when(nation != 1, F.concat(F.lit("Home & "), F.col("s_name"))).alias("name"))

    @cached_property
    def registration_feed(self) -> DataFrame:
        nation, key = F.col("c_nationkey"), _text("c_custkey")
        stored = F.concat(F.lower("c_name"), F.lit("@example.com"))
        return self.star("customer").select(
            F.col("c_custkey").alias("seq"),
            F.when(nation == 0, F.upper("c_name"))
            .when(nation == 7, F.concat(F.lit("shared "), F.floor(F.col("c_custkey") / 50).cast("string")))
            .otherwise(F.concat(F.lit("new "), key)).alias("username"),
            F.when(nation == 1, F.upper(stored)).when(nation == 2, "no-at-sign")
            .when(nation == 3, F.concat(F.lit("  spaced"), key, F.lit("@example.com\t")))
            .when(nation == 4, "").when(nation == 6, "a..b@example.com")
            .when(nation != 5, F.concat(F.lit("new"), key, F.lit("@example.org"))).alias("email"))

    @cached_property
    def user_replacements(self) -> DataFrame:
        """Rows colliding on the id, the user name, the email, with two users at
        once, or with one another."""
        key = F.col("c_custkey")
        kind = F.col("c_nationkey") % 5
        fresh = F.concat(F.lit("rep"), _text("c_custkey"))
        neighbour = F.concat(F.lit("Customer#"), F.lpad((key + 1).cast("string"), 9, "0"))
        return self.star("customer").where(F.col("c_mktsegment") == "BUILDING").select(
            key.alias("seq"),
            F.when(kind.isin(0, 3), key).otherwise(key + NEW_USER_IDS).alias("id"),
            F.when(kind == 1, F.upper("c_name")).when(kind == 3, neighbour)
            .when(kind == 4, F.concat(F.lit("dup"), F.floor(key / 100).cast("string")))
            .otherwise(fresh).alias("username"),
            F.when(kind == 2, F.concat(F.lower("c_name"), F.lit("@example.com")))
            .otherwise(F.concat(fresh, F.lit("@example.org"))).alias("email"),
            F.lit("Replaced").alias("full_name"), F.lit("user").alias("role"))

    @cached_property
    def checkout_requests(self) -> DataFrame:
        """Who pays, with blank cards among them and some asking twice."""
        nation, key = F.col("c_nationkey"), F.col("c_custkey")
        card = (F.when(F.col("c_mktsegment") == "AUTOMOBILE", "").when(nation == 0, "0")
                .otherwise(F.concat(F.lit("Card "), _text("c_custkey"))))
        first = F.struct((key * 10).alias("request_id"), card.alias("card_name"),
                         F.when(nation >= 5, "paypal").alias("payment_method"))
        second = F.struct((key * 10 + 1).alias("request_id"), F.lit("Second").alias("card_name"),
                          F.lit("debit_card").alias("payment_method"))
        asks = F.when(F.col("c_mktsegment") == "BUILDING", F.array(first, second)).otherwise(
            F.array(first))
        return (
            self.star("customer").where(F.col("c_mktsegment") != "FURNITURE")
            .select(key.alias("user_id"),
                    F.when(nation <= 20, F.concat(F.lit("Street "), _text("c_custkey"))).alias("address"),
                    F.explode(asks).alias("a"))
            .select("a.request_id", "user_id", "a.card_name", "a.payment_method", "address"))

    @cached_property
    def cart_edits(self) -> DataFrame:
        """New quantities for every cart line, a quarter under a wrong owner."""
        owner = F.when(F.col("product_id") % 4 == 0, F.col("user_id") + 1).otherwise(F.col("user_id"))

        def edit(seq, quantity):
            return F.struct(F.lit(seq).alias("seq"), quantity.alias("quantity"))

        edits = F.when(F.col("quantity") > 5, F.array(
            edit(1, (F.col("product_id") % 3).cast("string")), edit(2, F.lit("12 pieces")))
        ).otherwise(F.array(edit(1, (F.col("product_id") % 3).cast("string"))))
        return (self.cart_items.select("id", owner.alias("user_id"), F.explode(edits).alias("e"))
                .select("id", "user_id", "e.seq", "e.quantity"))

    @cached_property
    def cart_removals(self) -> DataFrame:
        owner = F.when(F.col("product_id") % 4 == 0, F.col("user_id") + 1).otherwise(F.col("user_id"))
        return self.cart_items.where(F.col("quantity") <= 3).select("id", owner.alias("user_id"))

    @cached_property
    def requested_categories(self) -> DataFrame:
        """Category ids asked for, among them ids that do not exist."""
        return self.star("part").select(
            F.when(F.col("p_size") < 10, F.col("p_partkey") + 5_000_000)
            .otherwise(F.substring("p_brand", 7, 9).cast("bigint")).alias("category_id"))

    # ---- unchecked inputs for the integrity jobs ----

    @cached_property
    def unchecked(self) -> dict:
        """Tables as delivered, before any constraint was enforced."""
        feed = self.registration_feed.select(
            "username", "email", F.when(F.col("seq") % 7 == 0, "guest").otherwise("user").alias("role"))
        events = self._events("view", "error", "signup", "click", "purchase")
        pairs = {"product_id": F.when(F.col("k") != 99, F.col("k")), "user_id": F.col("user_id")}
        as_delivered = self.star("orders")
        return {
            "users": self.users.select("username", "email", "role").unionByName(feed),
            "categories": self.categories.select("name", "slug").unionByName(
                self.category_feed.select("name", slugify("name").alias("slug"))),
            "products": self.product_feed.select(
                "name", slugify("name").alias("slug"), "price",
                F.concat(F.lit("SKU-"), F.col("category_id").cast("string")).alias("sku")),
            "product_variants": self.product_variants.select(
                "product_id", "variant_name", "variant_value", "sku"),
            "orders": as_delivered.select(
                F.concat(F.lit("ORD-"), _text("o_custkey")).alias("order_number"),
                F.col("o_totalprice").cast(MONEY).alias("total_amount"),
                F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_totalprice").cast(MONEY))
                .alias("subtotal"),
                F.when(F.col("o_orderstatus") == "F", "completed")
                .otherwise(F.col("o_orderstatus")).alias("status"),
                F.lower("o_orderpriority").alias("payment_status")),
            "order_items": self.order_items.select(
                "order_id", "product_id", F.when(F.col("quantity") != 50, F.col("quantity"))
                .alias("quantity"), "price_at_time", "total_price"),
            "reviews": events.select(
                *[c.alias(n) for n, c in pairs.items()],
                F.when(F.col("event_id") % 29 != 0, (F.col("event_id") % 7).cast("int"))
                .alias("rating")),
            "cart_items": events.select(
                *[c.alias(n) for n, c in pairs.items()], (F.col("event_id") % 4).alias("quantity")),
            "wishlist": self._events("signup").select(*[c.alias(n) for n, c in pairs.items()]),
            "coupons": self.coupon_feed.select("code", "discount_type", "discount_value"),
        }

    @cached_property
    def after_bare_deletes(self) -> dict:
        """All tables after parents were deleted without following the keys."""
        products = self.products.join(self.deleted_products, "id", "left_anti")
        gone = self.user_deletions.select(F.col("user_id").alias("id"))
        return {
            "categories": self.categories.join(self.deleted_categories, "id", "left_anti"),
            "products": products,
            "product_variants": self.product_variants.where(F.col("variant_value") != "Large"),
            "users": self.users.join(gone, "id", "left_anti"),
            "orders": self.orders.where(F.col("status") != "cancelled"),
            "order_items": self.order_items,
            "reviews": self.reviews,
            "cart_items": self.cart_items,
            "wishlist": self.wishlist,
        }
