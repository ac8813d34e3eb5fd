"""Skip- and replace-on-collision against row-by-row brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tillworks.operators import groups, inserts
from tillworks.operators.ids import assign_ids, next_id
from tillworks.operators.inserts import insert_ignore, replace_into
from tillworks.session import cut_lineage

SCHEMA = "id bigint, username string, email string, seq bigint"
KEYS = [["id"], ["username"], ["email"]]


def _collide(a, b):
    def same(x, y):
        return x is not None and y is not None and str(x).lower() == str(y).lower()
    return any(same(a[i], b[i]) for i in range(3))


def _ignore_one_by_one(table, rows):
    held = list(table)
    for row in sorted(rows, key=lambda r: r[3]):
        if not any(_collide(row, other) for other in held):
            held.append(row)
    return held


def _replace_one_by_one(table, rows):
    held, displaced = list(table), set()
    for row in sorted(rows, key=lambda r: r[3]):
        displaced |= {h[0] for h in held if h in table and _collide(row, h)}
        held = [h for h in held if not _collide(row, h)] + [row]
    return held, displaced


def _random_case(seed, n_rows):
    rng = random.Random(seed)
    table = [(i, f"u{i}", f"e{i}", None) for i in range(12)]

    def text(letter):
        value = rng.choice([f"{letter}{rng.randrange(30)}", f"{letter}{rng.randrange(30)}".upper(), None])
        return value

    rows = [(rng.randrange(40), text("u"), text("e"), s) for s in rng.sample(range(1000), n_rows)]
    return table, rows


def _sorted(rows):
    return sorted(map(str, map(tuple, rows)))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_insert_ignore_under_three_keys(spark, seed):
    table, rows = _random_case(seed, 40)
    out = insert_ignore(spark.createDataFrame(table, SCHEMA), spark.createDataFrame(rows, SCHEMA),
                        KEYS, "seq")
    assert _sorted(out.collect()) == _sorted(_ignore_one_by_one(table, rows))


@pytest.mark.parametrize("seed", [4, 5])
def test_replace_into_under_three_keys(spark, seed):
    table, rows = _random_case(seed, 40)
    out, displaced = replace_into(spark.createDataFrame(table, SCHEMA),
                                  spark.createDataFrame(rows, SCHEMA), KEYS, "seq")
    held, gone = _replace_one_by_one(table, rows)
    assert _sorted(out.collect()) == _sorted(held)
    assert {r.id for r in displaced.collect()} == gone


def test_a_chain_of_collisions_is_settled_in_order(spark):
    # each row collides with the next one only, so every second row is accepted
    rows = [(i, f"u{i // 2}", f"e{(i + 1) // 2}", i) for i in range(9)]
    empty = spark.createDataFrame([], SCHEMA)
    out = insert_ignore(empty, spark.createDataFrame(rows, SCHEMA), KEYS, "seq")
    assert sorted(r.seq for r in out.collect()) == [0, 2, 4, 6, 8]


def test_rejected_row_does_not_shadow_a_later_valid_one(spark):
    reviews = "id bigint, product_id bigint, user_id bigint"
    users = spark.createDataFrame([(101,)], "id bigint")
    table = spark.createDataFrame([(1, 7, 101)], reviews)
    rows = spark.createDataFrame(
        [(2, 1, 2), (3, 1, 101), (4, 1, 101), (5, 7, 101), (6, None, 101), (7, None, 101)], reviews)
    key = [["product_id", "user_id"]]
    out = insert_ignore(table, rows, key, "id", [("user_id", users, "id")])
    assert sorted(r.id for r in out.collect()) == [1, 3, 6, 7]
    again = insert_ignore(out, rows.where("product_id IS NOT NULL"), key, "id", [("user_id", users, "id")])
    assert sorted(r.id for r in again.collect()) == [1, 3, 6, 7]


def test_null_foreign_keys_pass(spark):
    parents = spark.createDataFrame([(1,)], "id bigint")
    rows = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "id bigint, parent_id bigint")
    out = insert_ignore(rows.limit(0), rows, [["id"]], "id", [("parent_id", parents, "id")])
    assert sorted(r.id for r in out.collect()) == [1, 3]


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_ids_do_not_depend_on_partitioning(spark, partitions):
    rows = [(f"k{(i * 37) % 101:03d}",) for i in range(101)]
    df = spark.createDataFrame(rows, "k string").repartition(partitions)
    out = assign_ids(df, ["k"], 1000).collect()
    assert sorted((r.k, r.id) for r in out) == [(f"k{i:03d}", 1000 + i) for i in range(101)]


def test_ids_of_an_empty_feed_and_next_id(spark):
    empty = spark.createDataFrame([], "k string, id bigint")
    assert assign_ids(empty.drop("id"), ["k"], 5).count() == 0
    assert next_id(empty, 100) == 100
    assert next_id(spark.createDataFrame([(7,), (300,)], "id bigint"), 100) == 301


def _edits_one_by_one(table, edits):
    held, kept = dict(table), []
    for seq, row, slug in sorted(edits):
        others = {s for i, s in held.items() if i != row and s is not None}
        if row in held and slug not in others:
            held[row] = slug
            kept.append(seq)
    return kept


def _kept(spark, table, edits):
    out = inserts.holding_edits(
        spark.createDataFrame(table, "id bigint, slug string"),
        spark.createDataFrame(edits, "seq bigint, id bigint, slug string"), ["slug"], "seq")
    return sorted(r.seq for r in out.collect())


def test_an_edit_cannot_take_a_key_another_row_has_at_that_moment(spark):
    table = [(1, "a"), (2, "b"), (3, "c"), (4, None)]
    edits = [(1, 2, "a"),   # held by another row
             (2, 1, "x"),   # frees "a", which row 3 takes
             (3, 3, "a"),
             (4, 3, "y"), (5, 4, "y"), (6, 3, "y"),
             (7, 9, "z"), (8, 2, "z"),  # an unknown row asks for nothing
             (9, 4, None)]
    assert _kept(spark, table, edits) == _edits_one_by_one(table, edits) == [2, 3, 4, 6, 8, 9]


@pytest.mark.parametrize("group_rows", [100_000, 5])
def test_edits_equal_a_replay(spark, monkeypatch, group_rows):
    """Settled in one task, or in rounds, or both."""
    monkeypatch.setattr(groups, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(groups, "STRETCH", 4)
    rng = random.Random(group_rows)
    table = [(i, f"s{i}" if i % 5 else None) for i in range(12)]
    table += [(100 + i, f"t{i}") for i in range(30)]
    edits = [(s, rng.choice([0, 1, 2, 3, rng.randrange(14)]),
              rng.choice([f"s{rng.randrange(14)}", "s1", None, f"n{s}"])) for s in range(40)]
    # a long hand-over: each row takes what the one before it has just given up
    edits += [(100 + i, 100 + i, f"t{i - 1}" if i else "gone") for i in range(30)]
    assert _kept(spark, table, edits) == _edits_one_by_one(table, edits)


def test_a_chain_of_200_registrations_takes_few_writes(spark, monkeypatch):
    writes = []
    for module in (inserts, groups):
        monkeypatch.setattr(module, "cut_lineage", lambda df: (writes.append(1), cut_lineage(df))[1])
    rows = [(i, f"u{i // 2}", f"e{(i + 1) // 2}", i) for i in range(200)]
    out = insert_ignore(spark.createDataFrame([], SCHEMA), spark.createDataFrame(rows, SCHEMA),
                        [["username"], ["email"]], "seq")
    assert sorted(r.seq for r in out.collect()) == list(range(0, 200, 2))
    assert len(writes) <= 10


@pytest.mark.parametrize("group_rows", [6])
def test_groups_too_large_for_a_task_go_in_rounds(spark, monkeypatch, group_rows):
    monkeypatch.setattr(groups, "GROUP_ROWS", group_rows)
    table, rows = _random_case(9, 40)
    out = insert_ignore(spark.createDataFrame(table, SCHEMA), spark.createDataFrame(rows, SCHEMA),
                        KEYS, "seq")
    assert _sorted(out.collect()) == _sorted(_ignore_one_by_one(table, rows))


def test_connected_groups_of_shuffled_chains_and_a_star(spark, monkeypatch):
    rng = random.Random(3)
    order = rng.sample(range(300), 300)
    members = [(order[i], h) for i in range(300) if i % 60 for h in (i, i + 1)]
    members += [(1000 + i, -1) for i in range(500)]
    monkeypatch.setattr(groups, "GROUP_ROWS", 600)
    rows = spark.createDataFrame(members, "row bigint, hub bigint")
    shared = rows.groupBy("hub").agg(F.min("row").alias("first"))
    found = groups.connected_groups(cut_lineage(rows.join(shared, "hub")))
    small, large = groups.competing(rows)
    assert (small.count(), large.count()) == (795, 0)
    named = {r["row"]: r["group"] for r in found.collect()}
    for part in range(5):
        chain = order[part * 60 + 1:part * 60 + 60]
        assert {named[i] for i in chain} == {min(chain)}
    assert all(named[1000 + i] == 1000 for i in range(500)) and len(named) == 795


def test_a_small_feed_does_not_move_the_stored_table(spark):
    stored = spark.range(300_000).selectExpr("id", "concat('s', id) as slug")
    path = f"{spark.conf.get('spark.checkpoint.dir')}/stored-slugs"
    stored.write.mode("overwrite").parquet(path)
    stored = spark.read.parquet(path)
    feed = spark.createDataFrame([(1, "s5"), (2, "new"), (3, "new")], "seq bigint, slug string")
    values = inserts._stored_values(feed, ["slug"])
    named = inserts._values(stored, ["slug"]).join(values, ["_k0"])
    shown = named._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in shown and "Exchange hashpartitioning" not in shown
    out = inserts.accepted_rows(stored, feed, [["slug"]], "seq").collect()
    assert [(r.seq, r.slug) for r in out] == [(2, "new")]


def test_replacing_with_a_third_of_the_feed_on_one_email(spark):
    table = spark.createDataFrame([(1, "m0", "a"), (2, "m1", "b")],
                                  "id bigint, email string, name string")
    feed = spark.range(3000).selectExpr(
        "id as seq", "id + 100 as id", "if(id % 3 = 0, 'm0', concat('n', id)) as email",
        "concat('u', id) as name")
    out, gone = inserts.replace_into(table, feed, [["id"], ["email"]], "seq")
    assert out.count() == 2000 + 1 + 1 and [r.id for r in gone.collect()] == [1]
    assert out.where("email = 'm0'").first().name == "u2997"
