"""Rows that compete for the same keys: finding who competes with whom, settling them in order.

Rows and keys form a graph. What happens in one connected group does not depend on the others,
so groups of bounded size are settled whole, in feed order, by one task; however long the
chains in them are, this takes one pass. Where all competing rows together stay within
``GROUP_ROWS`` they count as one group and nothing is searched. Groups beyond that are left to
the caller's rounds.
"""

import pyarrow as pa

from pyspark.sql import DataFrame, Window, functions as F

from tillworks.session import cut_lineage

GROUP_ROWS = 100_000
STRETCH = 100_000


def competing(members: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows that share a hub with another, as (row, group): those of groups that one task can
    settle, and those of larger groups, or None if there are none.

    ``members`` is (row, hub), each pair once. Outcomes do not depend on which way is taken.
    """
    shared = members.groupBy("hub").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    links = cut_lineage(members.join(shared.where("n > 1").select("hub", "first"), "hub"))
    if links.count() <= GROUP_ROWS:
        return links.select("row", F.lit(0).cast("bigint").alias("group")).distinct(), None
    groups = connected_groups(links)
    sizes = cut_lineage(groups.groupBy("group").agg(F.count("*").alias("n")))
    sized = groups.join(sizes, "group")
    small = F.col("n") <= GROUP_ROWS
    return sized.where(small).drop("n"), sized.where(~small).drop("n")


def connected_groups(links: DataFrame) -> DataFrame:
    """(row, group) for ``links`` (row, hub, first), where ``first`` is the hub's least row.

    A group is named by its least row. Each round takes the least name among a row's
    neighbours, passes it on to the row that gave the old name, and then follows names
    twice, so the rounds grow with the logarithm of a chain's length. Every round is written.
    """
    names = links.groupBy("row").agg(F.min("first").alias("group"))
    while True:
        around = cut_lineage(links.join(names, "row").groupBy("hub").agg(
            F.min("group").alias("near"), F.max("group").alias("far")))
        if around.where("near < far").isEmpty():
            return names
        near = links.join(around.drop("far"), "hub").groupBy("row").agg(F.min("near").alias("near"))
        both = names.join(near, "row")
        passed = both.groupBy(F.col("group").alias("row")).agg(F.min("near").alias("passed"))
        names = cut_lineage(both.join(passed, "row", "left").select(
            "row", F.least("group", "near", "passed").alias("group")))
        names = _follow(_follow(names))


def _follow(names: DataFrame) -> DataFrame:
    """Each row's name becomes its name's name."""
    return names.join(names.select(F.col("row").alias("group"), F.col("group").alias("next")),
                      "group").select("row", F.col("next").alias("group"))


def first_come(rows: DataFrame) -> DataFrame:
    """The rows that come before all others sharing a key, skipping those skipped: (row).

    ``rows`` is (group, row, keys); rows count in ascending order, ``keys`` are strings.
    """
    def settle(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        taken, kept = set(), []
        for row, keys in zip(table.column("row").to_pylist(), table.column("keys").to_pylist()):
            if taken.isdisjoint(keys):
                taken.update(keys)
                kept.append(row)
        return pa.table({"row": pa.array(kept, pa.int64())})

    return rows.groupBy("group").applyInArrow(settle, "row bigint")


def replayed(edits: DataFrame) -> DataFrame:
    """The accepted among edits made one by one: (row).

    ``edits`` is (group, row, id, want, holder, has): edit ``row`` gives ``id`` the value
    ``want``, which ``holder`` has at the beginning; ``has`` is what ``id`` has then. An edit
    is rejected if another id has the value at that moment. NULL is nobody's.
    """
    def settle(table: pa.Table) -> pa.Table:
        edits = table.sort_by("row").to_pylist()
        holds = {e["id"]: e["has"] for e in edits}
        holder = {e["want"]: e["holder"] for e in edits if e["holder"] is not None}
        kept = []
        for e in edits:
            if e["want"] is None or holder.get(e["want"], e["id"]) == e["id"]:
                kept.append(e["row"])
                if holder.get(holds[e["id"]]) == e["id"]:
                    del holder[holds[e["id"]]]
                holds[e["id"]] = e["want"]
                if e["want"] is not None:
                    holder[e["want"]] = e["id"]
        return pa.table({"row": pa.array(kept, pa.int64())})

    return edits.groupBy("group").applyInArrow(settle, "row bigint")


def replayed_in_rounds(edits: DataFrame) -> DataFrame:
    """As ``replayed`` for groups of any size, in rounds.

    A round settles, for every value, the edits up to the next open move of its holder: while
    the holder stays, other ids are rejected; once it has left, the first edit gets
    the value. Rounds are as many as the longest chain of hand-overs.
    """
    start = cut_lineage(edits.where("want is not null and holder is not null").groupBy(
        "want").agg(F.min("holder").alias("holder")))
    accepted = cut_lineage(edits.where("want is null").select("row", "id", "want"))
    waiting = cut_lineage(edits.where("want is not null").select("row", "id", "want"))
    while not waiting.isEmpty():
        heads = waiting.groupBy("want").agg(F.min("row").alias("head"))
        taken = accepted.where("want is not null").groupBy("want").agg(F.max("row").alias("since"))
        last = taken.join(accepted.select(F.col("row").alias("since"), F.col("id").alias("by")),
                          "since")
        now = cut_lineage(heads.join(last, "want", "left").join(start, "want", "left").select(
            "want", "head", F.coalesce("by", "holder").alias("by"),
            F.coalesce("since", F.lit(-1)).alias("since")))
        moves = waiting.select("row", "id", F.lit(True).alias("open")).unionByName(
            accepted.select("row", "id", F.lit(False).alias("open")))
        state = now.join(_next_moves(now, moves), "want", "left").withColumn(
            "next", F.coalesce("next", F.lit((1 << 63) - 1)))
        free = F.col("by").isNull() | (F.col("next") < F.col("head"))
        # not known yet: the holder has an open move before the head
        state = cut_lineage(state.where(F.col("by").isNull() | (F.col("next") >= F.col("head"))
                                        | ~F.col("open")).withColumn("free", free))
        judged = cut_lineage(waiting.join(state, "want").where(
            F.when(F.col("free"), F.col("row") == F.col("head")).otherwise(
                F.col("row") <= F.col("next"))).select(
            "row", "id", "want", (F.col("free") | (F.col("id") == F.col("by"))).alias("good")))
        accepted = cut_lineage(accepted.unionByName(judged.where("good").drop("good")))
        waiting = cut_lineage(waiting.join(judged.select("row"), "row", "left_anti"))
    return accepted.select("row")


def _next_moves(now: DataFrame, moves: DataFrame) -> DataFrame:
    """(want, next, open): the first of ``moves`` (row, id, open) of ``by`` after ``since``.

    Rows are looked up in stretches of ``STRETCH`` numbers and then over stretches, so an id
    with much of the feed is spread over tasks.
    """
    takes = now.where("by is not null").select(
        F.col("since").alias("row"), F.col("by").alias("id"), "want",
        F.lit(None).cast("boolean").alias("open"))
    both = takes.unionByName(moves.withColumn("want", F.lit(None).cast("string"))).withColumn(
        "stretch", F.expr(f"row div {STRETCH}"))
    move = F.when(F.col("open").isNotNull(), F.struct("row", "open"))
    # from the end, the last move passed is the next one; a take at a move's row precedes none
    passed = Window.partitionBy("id", "stretch").orderBy(F.desc("row")).rangeBetween(
        Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.last(move, ignorenulls=True).over(passed)).where("open is null")
    beyond = Window.partitionBy("id").orderBy(F.desc("stretch")).rowsBetween(
        Window.unboundedPreceding, -1)
    firsts = cut_lineage(both.groupBy("id", "stretch").agg(F.min(move).alias("first")).withColumn(
        "far", F.last("first", ignorenulls=True).over(beyond)).select("id", "stretch", "far"))
    return near.join(firsts, ["id", "stretch"]).withColumn(
        "found", F.coalesce("near", "far")).where("found is not null").select(
        "want", F.col("found.row").alias("next"), F.col("found.open").alias("open"))
