"""Integrity jobs: what the data model declares, checked over whole tables.

The reports read each table once for all of its checks. Checked values carry
the number of their check, are grouped first (combining before the shuffle), and
only the groups are joined or filtered, so neither a duplicate key nor an orphan
value shared by many rows skews the work.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tillworks.schemas import (CASE_INSENSITIVE, ENUMS, FOREIGN_KEYS, NOT_NULL, RANGES,
                               UNIQUE_KEYS)


def _comparable(c):
    return F.lower(c) if c in CASE_INSENSITIVE else F.col(c)


def _union(parts):
    return reduce(DataFrame.unionByName, parts)


def _label(labels, number="check") -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in labels]), F.col(number) + 1)


def _checked_values(tables: dict, checks) -> DataFrame:
    """One row (check, value) per row and check, without the NULL values.

    ``checks`` lists (table name, value column); a check's number is its place.
    """
    parts = []
    for name in dict.fromkeys(table for table, _ in checks):
        values = [F.struct(F.lit(i).alias("check"), value.alias("value"))
                  for i, (table, value) in enumerate(checks) if table == name]
        parts.append(tables[name].select(F.inline(F.array(*values))))
    return _union(parts).where(F.col("value").isNotNull())


def _grouped(values: DataFrame) -> DataFrame:
    return values.groupBy("check", "value").agg(F.count(F.lit(1)).alias("n"))


def duplicate_keys(df: DataFrame, cols) -> DataFrame:
    """Key values held by more than one row; keys with a NULL are exempt."""
    keys = [_comparable(c).alias(c) for c in cols]
    return (df.select(*keys).dropna()
            .groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))


def duplicate_key_report(tables: dict) -> DataFrame:
    """Duplicate values of every unique key of the given tables."""
    keys = [(name, key) for name, keys in UNIQUE_KEYS.items() if name in tables for key in keys]

    def text(key):
        parts = [_comparable(c).cast("string") for c in key]
        return reduce(lambda a, b: F.concat(a, F.lit("|"), b), parts)

    groups = _grouped(_checked_values(tables, [(name, text(key)) for name, key in keys]))
    return groups.where(F.col("n") > 1).select(
        _label([name for name, _ in keys]).alias("table_name"),
        _label([",".join(key) for _, key in keys]).alias("key_name"),
        F.col("value").alias("key_value"), "n")


def orphans(child: DataFrame, fk: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Foreign key values without a parent row, and how many rows hold each."""
    held = child.where(F.col(fk).isNotNull()).groupBy(fk).agg(F.count(F.lit(1)).alias("n"))
    return held.join(parent.select(F.col(parent_key).alias(fk)), fk, "left_anti").select(fk, "n")


def orphan_report(tables: dict) -> DataFrame:
    """Orphan values of every foreign key between the given tables."""
    keys = [(child, fk, parent) for child, fk, parent, _ in FOREIGN_KEYS
            if child in tables and parent in tables and fk in tables[child].columns]
    parents = sorted({parent for _, _, parent in keys})
    held = _grouped(_checked_values(
        tables, [(child, F.col(fk).cast("bigint")) for child, fk, _ in keys]))
    known = _union([
        tables[parent].select(F.lit(i).alias("parent"), F.col("id").alias("value"),
                              F.lit(True).alias("known"))
        for i, parent in enumerate(parents)])
    # an outer join, as an anti join would be moved below the grouping
    missing = (held.withColumn("parent", _label([parents.index(p) for _, _, p in keys]))
               .join(known, ["parent", "value"], "left").where(F.col("known").isNull()))
    return missing.select(
        _label([child for child, _, _ in keys]).alias("table_name"),
        _label([fk for _, fk, _ in keys]).alias("column_name"),
        F.col("value").alias("missing_id"), "n")


def domain_report(tables: dict) -> DataFrame:
    """Values outside their enumeration or range; NULL is allowed."""
    rules = [(name, column, ~F.col(column).isin(*allowed))
             for name, columns in ENUMS.items() if name in tables
             for column, allowed in columns.items()]
    rules += [(name, column, ~F.col(column).between(low, high))
              for name, columns in RANGES.items() if name in tables
              for column, (low, high) in columns.items()]
    bad = [(name, F.when(outside, F.col(column).cast("string"))) for name, column, outside in rules]
    return _grouped(_checked_values(tables, bad)).select(
        _label([name for name, _, _ in rules]).alias("table_name"),
        _label([column for _, column, _ in rules]).alias("column_name"), "value", "n")


def null_violations(df: DataFrame, cols) -> DataFrame:
    """Per required column the number of NULLs, counted in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n")) for c in cols])))


def null_report(tables: dict) -> DataFrame:
    return _union([
        null_violations(tables[name], cols).select(
            F.lit(name).alias("table_name"), "column_name", "n")
        for name, cols in NOT_NULL.items() if name in tables])
