"""Change feeds applied to table snapshots: (snapshot, changes) -> new snapshot.

Every feed is reduced to one row per key with a map-side combinable aggregate
(``max``/``min``/``sum``) before it meets the snapshot, so a key that holds a
large share of the feed never lands whole in one task.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tillworks.schemas import CASCADE, DEFAULTS, FOREIGN_KEYS, NOW, SCHEMAS
from tillworks.session import cut_lineage


def _names(cols):
    return [cols] if isinstance(cols, str) else list(cols)


def at(moment) -> Column:
    """A job's reference moment as a zone-free timestamp literal."""
    return F.lit(str(moment)).cast("timestamp_ntz")


def append_with_defaults(table: DataFrame, rows: DataFrame, name: str, as_of) -> DataFrame:
    """Append rows; columns absent from ``rows`` take the table's default.

    An explicit NULL in ``rows`` stays NULL.
    """
    for column, value in DEFAULTS[name].items():
        if column in table.columns and column not in rows.columns:
            filled = at(as_of) if value is NOW else F.lit(value)
            rows = rows.withColumn(column, filled.cast(table.schema[column].dataType))
    typed = [F.col(c).cast(table.schema[c].dataType).alias(c) for c in rows.columns]
    return table.unionByName(rows.select(*typed), allowMissingColumns=True).select(*table.columns)


def touched(fresh: dict, columns, as_of) -> dict:
    """The new values by column, with ``updated_at`` moved where one of them differs.

    A batch counts as one update: what it sets and sets back is not a change. Deletes that
    reach a row through a foreign key do not touch it, as in the shop's database.
    """
    if as_of is None or "updated_at" not in columns:
        return fresh
    same = reduce(lambda a, b: a & b, [new.eqNullSafe(F.col(c)) for c, new in fresh.items()])
    return fresh | {"updated_at": F.when(same, F.col("updated_at")).otherwise(at(as_of))}


def with_values(table: DataFrame, fresh: dict, columns) -> DataFrame:
    """``columns`` of the table, those in ``fresh`` with their new values."""
    return table.select(*[fresh[c].alias(c) if c in fresh else F.col(c) for c in columns])


def latest_rows(changes: DataFrame, key, order: str) -> DataFrame:
    """Each key's row with the largest ``order``, which is unique per key.

    The largest numbers come from a hash aggregation of fixed-width columns, which a
    struct of the values would turn into a sort of the feed; the rows are then looked up.
    """
    newest = changes.groupBy(*key).agg(F.max(order).alias(order))
    return changes.join(newest, [*key, order], "left_semi")


def apply_updates(table: DataFrame, changes: DataFrame, key, order, cols,
                  as_of=None) -> DataFrame:
    """Overwrite ``cols`` with each key's latest change.

    ``order`` must be unique per key. A NULL in the latest change is written as
    NULL; keys the table does not hold are ignored. With ``as_of``, rows whose values
    change get it as ``updated_at``. Unique keys among ``cols`` are not checked here, see
    ``inserts.holding_edits``.
    """
    key, cols = _names(key), _names(cols)
    new = latest_rows(changes, key, order).select(
        *key, F.lit(True).alias("_changed"), *[F.col(c).alias(f"_new_{c}") for c in cols])
    fresh = {c: F.when(F.col("_changed"), F.col(f"_new_{c}").cast(table.schema[c].dataType))
             .otherwise(F.col(c)) for c in cols}
    return with_values(table.join(new, key, "left"), touched(fresh, table.columns, as_of),
                       table.columns)


# What a toggle form without a submitted value counts as.
_UNSUBMITTED = {"is_active": True, "is_featured": False, "is_premium": False}


def apply_toggles(table: DataFrame, toggles: DataFrame, cols, key="id", order="seq",
                  as_of=None) -> DataFrame:
    """Set each of ``cols`` to the opposite of the value submitted as ``current``.

    The submitted value counts, not the stored one. Several columns take one pass.
    """
    flipped = [(~F.coalesce("current", F.lit(_UNSUBMITTED[c]))).alias(c) for c in _names(cols)]
    return apply_updates(table, toggles.select(*_names(key), *_names(order), *flipped), key, order,
                         cols, as_of)


def delete_keys(table: DataFrame, keys: DataFrame, on) -> DataFrame:
    """Drop the rows whose key (or key and owner) occurs in ``keys``.

    For feeds against a table that holds each key once: a key repeated in the
    feed is reduced to one row before the shuffle.
    """
    return table.join(keys.select(*_names(on)).distinct(), _names(on), "left_anti")


def delete_children(child: DataFrame, fk: str, parents: DataFrame, key: str = "id") -> DataFrame:
    """Drop the rows pointing at one of ``parents``, a stored set of unique keys.

    Many rows may point at one parent. The keys go into the join as they are read,
    as adaptive execution splits a hot key only where both inputs come straight
    from a shuffle.
    """
    return child.join(parents.select(F.col(key).alias(fk)), fk, "left_anti")


def clear_cart(cart: DataFrame, buyers: DataFrame) -> DataFrame:
    """Empty the cart of every buyer; ``buyers`` names each user once."""
    return delete_children(cart, "user_id", buyers, "user_id")


def deletable_users(requests: DataFrame) -> DataFrame:
    """Ids of the users to delete; administrators cannot delete themselves."""
    return requests.where(~F.col("user_id").eqNullSafe(F.col("admin_id"))).select(
        F.col("user_id").alias("id"))


def null_out(child: DataFrame, fk: str, keys: DataFrame, key: str = "id") -> DataFrame:
    """Set ``fk`` to NULL where it points at one of ``keys``."""
    return _null_children(child, fk, _stored_keys(keys, key))


def _stored_keys(keys: DataFrame, key: str) -> DataFrame:
    """Unique keys, written once: they meet several tables, see delete_children."""
    return cut_lineage(keys.select(F.col(key).alias("id")).distinct())


def _null_children(child: DataFrame, fk: str, parents: DataFrame) -> DataFrame:
    gone = parents.select(F.col("id").alias(fk), F.lit(True).alias("_gone"))
    kept = F.when(F.col("_gone").isNull(), F.col(fk)).alias(fk)
    return child.join(gone, fk, "left").select(
        *[kept if c == fk else F.col(c) for c in child.columns])


def cascade_delete(tables: dict, parent: str, keys: DataFrame, key: str = "id") -> dict:
    """Delete rows of ``parent`` and follow every declared foreign key.

    ``tables`` maps names to snapshots; only the tables given are changed.
    Returns a new map. A cascade into a table that is itself a parent is
    followed in turn.
    """
    out = dict(tables)
    gone = _stored_keys(keys, key)
    if parent in out:
        out[parent] = delete_children(out[parent], "id", gone)
    given = [(c, fk, p, action) for c, fk, p, action in FOREIGN_KEYS if c in out]
    parents = {p for _, _, p, _ in given}
    # plain children first, so later steps meet fewer rows
    for child, fk, target, action in sorted(given, key=lambda k: k[0] in parents):
        if target != parent:
            continue
        if action != CASCADE:
            out[child] = _null_children(out[child], fk, gone)
        elif child in parents:
            as_fk = gone.select(F.col("id").alias(fk))
            lost = tables[child].join(as_fk, fk, "left_semi").select("id")
            out = cascade_delete(out, child, lost)
        else:
            out[child] = delete_children(out[child], fk, gone)
    return out


def ensure_column(df: DataFrame, name: str, default, dtype=None) -> DataFrame:
    """Add a column with a default unless the table already has it."""
    if name in df.columns:
        return df
    value = F.lit(default)
    return df.withColumn(name, value.cast(dtype) if dtype is not None else value)


def conform(df: DataFrame, name: str) -> DataFrame:
    """Cast to the declared schema, adding absent columns as NULL."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in SCHEMAS[name].fields])
