"""Inserts under unique keys: skip-on-collision and replace-on-collision.

A key is a list of columns. A row with a NULL in a key collides with nothing on
that key. Text keys compare without case where the data model says so. ``order``
names a column that numbers the incoming rows uniquely.
"""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tillworks.operators.groups import competing, first_come, replayed, replayed_in_rounds
from tillworks.schemas import CASE_INSENSITIVE
from tillworks.session import cut_lineage


def _comparable(col):
    return F.lower(col) if col in CASE_INSENSITIVE else F.col(col)


def _key_columns(df: DataFrame, key, prefix="_k") -> DataFrame:
    """Add the comparable form of a key as _k0, _k1, …"""
    return df.withColumns({f"{prefix}{i}": _comparable(c) for i, c in enumerate(key)})


def _names(key, prefix="_k"):
    return [f"{prefix}{i}" for i in range(len(key))]


def _has_null(names):
    return reduce(lambda a, b: a | b, [F.col(n).isNull() for n in names])


def _joined(parts):
    """Values as one string, NULL if one of them is: equal only for equal values."""
    parts = [p.cast("string") for p in parts]
    return F.concat(*[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts])


def _exact(key):
    return _joined([_comparable(c) for c in key])


def _exact_names(key):
    return _joined([F.col(n) for n in _names(key)])


def _values(rows: DataFrame, key) -> DataFrame:
    """The comparable key of every row."""
    return _key_columns(rows.select(*key), key).select(*_names(key))


def _stored_values(rows: DataFrame, key) -> DataFrame:
    """The distinct keys of a feed, written once: a key shared by many of its rows is one row."""
    return cut_lineage(_values(rows, key).distinct())


def _outside(rows: DataFrame, values: DataFrame, key) -> DataFrame:
    """Rows whose ``key`` is not among ``values``."""
    return _key_columns(rows, key).join(values, _names(key), "left_anti").select(*rows.columns)


def _inside(rows: DataFrame, values: DataFrame, key) -> DataFrame:
    """Rows whose ``key`` is among ``values``."""
    return _key_columns(rows, key).join(values, _names(key), "left_semi").select(*rows.columns)


def _winners(rows: DataFrame, key, order, pick) -> DataFrame:
    """The order numbers of the first or last row of every group of equal keys.

    Rows with a NULL key form groups of their own. The aggregate combines before
    the shuffle, and its result is joined back on the unique order number, so a
    key shared by many rows stays spread out.
    """
    names = _names(key)
    alone = F.when(_has_null(names), F.col(order)).alias("_alone")
    keyed = _key_columns(rows.select(order, *key), key).select(order, *names, alone)
    return keyed.groupBy(*names, "_alone").agg(pick(order).alias(order)).select(order)


def _facts(asked: DataFrame, table: DataFrame, keys, fks) -> DataFrame:
    """What the feed asks about, written once: (_about, _value).

    Under ("parent", i) the parents that exist of those the feed names, under ("key", i) the
    keys of the feed that the table holds. ``asked`` is the feed's key columns as written, so
    a small feed is all that is shuffled or broadcast, however large the tables. Every value
    is there once, so joins with the feed may split a value many rows share.
    """
    parents = [parent.select(F.col(key).alias(column)).join(
        asked.select(column).distinct(), column).select(
        F.lit(f"parent {i}").alias("_about"), F.col(column).cast("string").alias("_value"))
        for i, (column, parent, key) in enumerate(fks)]
    held = [_values(table, key).join(_values(asked, key).distinct(), _names(key)).select(
        F.lit(f"key {i}").alias("_about"), _exact_names(key).alias("_value"))
        for i, key in enumerate(keys)]
    return cut_lineage(reduce(DataFrame.unionByName, parents + held)) if parents + held else None


def _looked_up(rows: DataFrame, value, facts: DataFrame, about: str, keep) -> DataFrame:
    """Rows for which ``keep`` holds, given whether ``facts`` has their value."""
    mine = facts.where(F.col("_about") == about).select("_value", F.lit(True).alias("_found"))
    found = F.col("_found").isNotNull()
    return rows.withColumn("_value", value).join(mine, "_value", "left").where(keep(found)).select(
        *rows.columns)


def _with_parents(rows: DataFrame, fks, facts) -> DataFrame:
    """Rows whose every foreign key is NULL or names an existing parent."""
    for i, (column, _, _) in enumerate(fks):
        rows = _looked_up(rows, F.col(column).cast("string"), facts, f"parent {i}",
                          lambda found, c=column: F.col(c).isNull() | found)
    return rows


def accepted_rows(table: DataFrame, rows: DataFrame, keys, order: str, fks=()) -> DataFrame:
    """The rows that inserting one by one in ``order`` would keep.

    Left out are rows with an unknown parent, rows colliding with the table, and
    rows colliding with an earlier row that was itself kept. What is decided is decided
    on the key columns, written once; whole rows follow by their order number.
    """
    columns = dict.fromkeys([order, *(c for key in keys for c in key), *(fk[0] for fk in fks)])
    asked = cut_lineage(rows.select(*columns))
    facts = _facts(asked, table, keys, fks)
    fresh = _with_parents(asked, fks, facts)
    if len(keys) == 1:
        # the feed shrinks to one row per key before it meets the table
        fresh = fresh.join(_winners(fresh, keys[0], order, F.min), order, "left_semi")
    for i, key in enumerate(keys):
        fresh = _looked_up(fresh, _exact(key), facts, f"key {i}", lambda found: ~found)
    if len(keys) > 1:
        fresh = _accept(fresh, keys, order)
    return rows.join(fresh.select(order), order, "left_semi").select(*rows.columns)


def insert_ignore(table: DataFrame, rows: DataFrame, keys, order: str, fks=()) -> DataFrame:
    """The table with the accepted rows appended; the others are skipped."""
    return table.unionByName(accepted_rows(table, rows, keys, order, fks).select(*table.columns))


def _accept(rows: DataFrame, keys, order: str) -> DataFrame:
    """First-come acceptance under several keys at once.

    Rows that share no key with another are accepted. Of the others, each connected group
    is settled by one task; groups too large for that go in rounds.
    """
    exact = [F.concat(F.lit(f"{i} "), _exact(key)) for i, key in enumerate(keys)]
    rows = cut_lineage(rows)
    keyed = rows.select(F.col(order).cast("bigint").alias("row"), F.array_compact(
        F.array(*exact)).alias("keys"))
    small, large = competing(keyed.select("row", F.explode("keys").alias("key")).select(
        "row", F.xxhash64("key").alias("hub")))
    settled = cut_lineage(first_come(keyed.join(small, "row")))
    met = small if large is None else small.unionByName(large)
    alone = rows.join(met, rows[order] == met["row"], "left_anti")
    kept = alone.unionByName(rows.join(settled, rows[order] == settled["row"], "left_semi"))
    if large is None or large.isEmpty():
        return kept
    return kept.unionByName(_accept_in_rounds(
        rows.join(large, rows[order] == large["row"], "left_semi"), keys, order))


def _accept_in_rounds(rows: DataFrame, keys, order: str) -> DataFrame:
    """First-come acceptance under several keys at once.

    A row that comes first in all of its key groups is accepted; rows colliding
    with it are dropped; the rest goes to the next round. The earliest open row
    is accepted in every round, so this ends, and the outcome equals inserting
    the rows one by one. Rounds are as many as the longest chain of rows that
    each wait for the one before.
    """
    open_rows = cut_lineage(rows)
    accepted = open_rows.limit(0)
    while not open_rows.isEmpty():
        first = open_rows
        for key in keys:
            first = first.join(_winners(open_rows, key, order, F.min), order, "left_semi")
        first = cut_lineage(first.select(*rows.columns))
        accepted = accepted.unionByName(first)
        rest = open_rows.join(first.select(order), order, "left_anti").select(*rows.columns)
        for key in keys:
            rest = _outside(rest, _values(first, key), key)
        open_rows = cut_lineage(rest)
    return accepted


def replace_into(table: DataFrame, rows: DataFrame, keys, order: str):
    """Insert rows in ``order``; each one first deletes whatever it collides with.

    A row stays in the end exactly if no later row shares any of its keys, and a
    stored row stays if no incoming row does. Returns ``(new table, displaced
    rows)``; the caller applies deletes of the displaced ids to child tables.
    """
    final = rows
    for key in keys:
        final = final.join(_winners(rows, key, order, F.max), order, "left_semi")
    kept, hits = table, []
    for key in keys:
        values = _stored_values(rows, key)
        kept = _outside(kept, values, key)
        hits.append(_inside(table, values, key))
    displaced = reduce(DataFrame.unionByName, hits).dropDuplicates(["id"])
    return kept.unionByName(final.select(*table.columns)), displaced


def holding_edits(table: DataFrame, edits: DataFrame, key, order: str) -> DataFrame:
    """The edits accepted when they are made one by one in ``order``.

    ``edits`` names rows of ``table`` by ``id`` and brings a new value for the columns of
    ``key``. An edit is rejected whole if another row has its value at that moment. A value that
    an earlier edit gave up is free, also if that edit is of the same feed. NULL belongs to
    nobody and is always accepted; edits of unknown rows are left out.
    """
    written = cut_lineage(edits.where("id is not null").select(
        F.col(order).cast("bigint").alias("row"), "id", *key))
    stored = table.select("id", _exact(key).alias("value"))
    # who has what the feed asks for, and what its rows have: unique keys, written together
    facts = cut_lineage(stored.join(written.select(_exact(key).alias("value")).distinct(), "value")
                        .select(F.lit(True).alias("holds"), "id", "value").unionByName(
        stored.join(written.select("id").distinct(), "id").select(
            F.lit(False).alias("holds"), "id", "value")))
    holders = facts.where("holds").select(F.col("value").alias("want"), F.col("id").alias("holder"))
    has = facts.where("not holds").select("id", F.col("value").alias("has"))
    judged = cut_lineage(written.select("row", "id", _exact(key).alias("want")).join(
        holders, "want", "left").join(has, "id"))
    hubs = F.array_compact(F.array(
        F.xxhash64(F.lit("id"), "id"),
        *[F.when(F.col(c).isNotNull(), F.xxhash64(F.lit("value"), c)) for c in ("want", "has")]))
    small, large = competing(judged.select("row", F.explode(F.array_distinct(hubs)).alias("hub")))
    met = small if large is None else small.unionByName(large)
    alone = judged.join(met, "row", "left_anti").where(
        F.col("holder").isNull() | (F.col("holder") == F.col("id"))).select("row")
    kept = alone.unionByName(replayed(judged.join(small, "row")))
    if large is not None:
        kept = kept.unionByName(replayed_in_rounds(judged.join(large, "row")))
    kept = cut_lineage(kept)
    return edits.join(kept, edits[order] == kept["row"], "left_semi")
