"""Existence probes and keyed lookups, for whole feeds at once."""

from pyspark.sql import DataFrame, functions as F

from tillworks.functions.columns import ALL_PRODUCTS, or_label
from tillworks.session import cut_lineage


def lookup(table: DataFrame, keys: DataFrame, on="id") -> DataFrame:
    """The rows of ``table`` whose key occurs in ``keys``."""
    return table.join(keys.select(on).distinct(), on, "left_semi").select(*table.columns)


def registration_conflicts(feed: DataFrame, users: DataFrame) -> DataFrame:
    """Which registrations clash with a stored user, and on what.

    Case is ignored. A clash on the user name is named before one on the email.
    Two equi joins replace the either-or probe, which would be a nested loop.
    """
    def taken(column, flag):
        name = f"_{column}"
        wanted = feed.select(F.lower(column).alias(name)).distinct()
        stored = users.select(F.lower(column).alias(name))
        # at most one row per value in the feed, written once, so that the join of
        # the whole feed can split a value shared by many of its rows
        found = cut_lineage(stored.join(wanted, name, "left_semi").distinct())
        return found.withColumn(flag, F.lit(True))

    probed = (
        feed.withColumns({"_username": F.lower("username"), "_email": F.lower("email")})
        .join(taken("username", "_name_taken"), "_username", "left")
        .join(taken("email", "_email_taken"), "_email", "left")
    )
    conflict = F.when(F.col("_name_taken"), "username").when(F.col("_email_taken"), "email")
    return probed.select(*feed.columns, conflict.alias("conflict"))


def category_titles(requested: DataFrame, categories: DataFrame) -> DataFrame:
    """Heading for every requested category id; unknown ids show all products."""
    names = categories.select(F.col("id").alias("category_id"), "name")
    return (requested.select("category_id").distinct()
            .join(names, "category_id", "left")
            .select("category_id", or_label("name", ALL_PRODUCTS).alias("title")))
