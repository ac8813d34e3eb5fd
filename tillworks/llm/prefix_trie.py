"""Prefix trie of conversations by whole-sequence collapse.

Conversations are ordered by turn, then role, then text, nulls first, null roles and texts as
empty; repeated rows are separate turns. Each conversation c is rebuilt: the first h original turns
of conversation c - c % 100, then its own turns after its first h, with h = crc32(c) % 6. Rebuilt
conversations that are identical become one weighted sequence with a list of its ends. A
sequence that is a proper prefix of another is dropped by an anti-join; the rest are the
leaves. Nodes are sums over the prefixes of weighted sequences; what a node holds for its subtree is
a sum over the leaves under it: each node's own share is counted by its least leaf alone.

A prefix is named by its depth and by sums of two hashes of (place, role, text) over its turns. Sums
can be made in any order and in parts, so a conversation that holds much of the table is split:
places come from a range partitioning, sums from bins of ``BIN`` places and then over bins.
Equal prefixes have equal names; unlike ones share a name only if 128 bits agree.

The list of ends of one node is hashed in one stream, from lines of ``LINE`` ids, so that no task
holds it whole. Rows with a null conversation id belong to no conversation. An empty table gives
an empty table, without a root. Other columns are ignored.
"""

import hashlib

import pyarrow as pa

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillworks.llm.common import small_batches
from tillworks.session import cut_lineage

SPAN, LONGEST_HEAD = 100, 6
BIN = 512
LINE = 1024
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits
_PARTS = ["s1", "s2", "s3", "s4"]
_NODE = ["ka", "kb"]


def place(rows: DataFrame, order: list, keep: list) -> DataFrame:
    """``keep`` of every row, and ``at``: its number from 0 in the given order.

    Equal rows are told apart by where they were read, so they are dealt out as well.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    full = [*order, F.col("tie")]
    placed = cut_lineage(
        rows.withColumn("tie", F.monotonically_increasing_id())
        .repartitionByRange(parts, *full).sortWithinPartitions(*full)
        .select(*keep, F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", _ROW_BITS).alias("part")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(part).agg(F.count("*").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    row = F.col("at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    # a row of two numbers per partition, so the broadcast is bounded
    return placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn(
        "at", row + F.col("offset")).drop("part", "offset")


def running(rows: DataFrame, key: str, at: str, columns: list) -> DataFrame:
    """The sums of ``columns`` over the rows of a key up to each row, as up_<column>.

    ``at`` numbers the rows of a key from 0 or 1 without gaps.
    """
    rows = rows.withColumn("bin", F.floor(F.col(at) / BIN))
    above = Window.partitionBy(key).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = cut_lineage(rows.groupBy(key, "bin").agg(
        *[F.sum(c).alias(c) for c in columns]).select(key, "bin", *[
            F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"above_{c}") for c in columns]))
    inside = Window.partitionBy(key, "bin").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(bins, [key, "bin"]).withColumns(
        {f"up_{c}": F.col(f"above_{c}") + F.sum(c).over(inside) for c in columns}).drop(
        "bin", *[f"above_{c}" for c in columns])


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, depth from 1, s1 to s4, chars) per rebuilt turn, and all conversations (conv)."""
    read = turns.select(
        F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("conv is not null")
    placed = place(read, [F.col("conv"), F.asc_nulls_first("turn"), F.col("role"), F.col("text")], [
        "conv", F.xxhash64("role", "text").alias("t1"),
        F.xxhash64("text", "role", F.lit(1)).alias("t2"),
        F.char_length("text").cast("bigint").alias("chars")])
    counted = cut_lineage(placed.groupBy("conv").agg(F.count("*").alias("n"),
                                                     F.min("at").alias("first")))
    from_base = counted.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    head = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(LONGEST_HEAD))
    convs = cut_lineage(counted.withColumns(
        {"base": F.col("conv") - F.col("conv") % SPAN, "head": head}).join(
        from_base, "base", "left").select(
        "conv", "first", "head", "base",
        F.least("head", F.coalesce("base_n", F.lit(0))).alias("lent")))
    numbered = placed.join(convs, "conv").withColumn("p", F.col("at") - F.col("first") + 1)
    own = numbered.where("p > head").select(
        "conv", (F.col("p") - F.col("head") + F.col("lent")).alias("depth"), "t1", "t2", "chars")
    # at most LONGEST_HEAD - 1 turns of a base, for at most two SPANs of conversations
    heads = cut_lineage(numbered.where((F.col("p") < LONGEST_HEAD) & (
        F.col("conv") == F.col("base"))).select("base", "p", "t1", "t2", "chars"))
    lent = convs.select("conv", "base", "head").join(heads, "base").where("p <= head").select(
        "conv", F.col("p").alias("depth"), "t1", "t2", "chars")
    one, two = F.xxhash64("depth", "t1"), F.xxhash64("t2", "depth")
    low = F.lit((1 << 32) - 1)
    rows = own.unionByName(lent).select(
        "conv", "depth", one.bitwiseAND(low).alias("s1"), F.shiftrightunsigned(one, 32).alias("s2"),
        two.bitwiseAND(low).alias("s3"), F.shiftrightunsigned(two, 32).alias("s4"), "chars")
    return cut_lineage(rows), convs.select("conv")


def _name(depth, sums, names):
    return [F.xxhash64(depth, *sums).alias(names[0]),
            F.xxhash64(*reversed(sums), depth).alias(names[1])]


def collapse(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Identical conversations as one: (ka, kb, conv, weight, length), and the ends (ka, kb,
    ends_sha256)."""
    sums = rows.groupBy("conv").agg(F.count("*").alias("length"), *[
        F.sum(c).alias(c) for c in _PARTS])
    nothing = F.lit(0).cast("bigint")
    whole = cut_lineage(convs.join(sums, "conv", "left").select(
        "conv", F.coalesce("length", nothing).alias("length"), *_name(
            F.coalesce("length", nothing), [F.coalesce(c, nothing) for c in _PARTS], _NODE)))
    sequences = cut_lineage(whole.groupBy(*_NODE).agg(
        F.min("conv").alias("conv"), F.count("*").alias("weight"),
        F.min("length").alias("length")))
    return sequences, cut_lineage(end_digests(whole))


def end_digests(whole: DataFrame) -> DataFrame:
    """SHA-256 of the ascending ids (conv) of each node, joined by commas."""
    spark = whole.sparkSession
    small_batches(spark)
    lines = place(whole, [F.col(c) for c in (*_NODE, "conv")], [*_NODE, "conv"]).groupBy(
        *_NODE, F.floor(F.col("at") / LINE).alias("line")).agg(
        F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def digest(batches):
        node, state = None, None
        for batch in batches:
            done = []
            for ka, kb, ids in zip(*(batch.column(c).to_pylist() for c in ("ka", "kb", "ids"))):
                if (ka, kb) == node:
                    state.update(b"," + ids.encode())
                    continue
                if node:
                    done.append((*node, state.hexdigest()))
                node, state = (ka, kb), hashlib.sha256(ids.encode())
            if done:
                yield _digest_batch(done)
        if node:
            yield _digest_batch([(*node, state.hexdigest())])

    return lines.repartition(parts, *_NODE).sortWithinPartitions(*_NODE, "line").mapInArrow(
        digest, "ka bigint, kb bigint, ends_sha256 string")


def _digest_batch(rows):
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))],
        names=["ka", "kb", "ends_sha256"])


def prefixes(rows: DataFrame, sequences: DataFrame) -> DataFrame:
    """Every prefix of every sequence: conv, depth, ka, kb, parent pa, pb, chars, weight, length."""
    kept = rows.join(sequences.select("conv", "weight", "length"), "conv")
    summed = running(kept, "conv", "depth", _PARTS)
    ups = [F.col(f"up_{c}") for c in _PARTS]
    turns = summed.select(
        "conv", "depth", *_name(F.col("depth"), ups, _NODE),
        *_name(F.col("depth") - 1, [F.col(f"up_{c}") - F.col(c) for c in _PARTS], ["pa", "pb"]),
        "chars", "weight", "length")
    zero = F.lit(0).cast("bigint")
    root = sequences.select(
        "conv", zero.alias("depth"), *_name(zero, [zero] * len(_PARTS), _NODE),
        F.lit(None).cast("bigint").alias("pa"), F.lit(None).cast("bigint").alias("pb"),
        zero.alias("chars"), "weight", "length")
    return cut_lineage(root.unionByName(turns))


def trie(turns: DataFrame) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    ``turns`` has conv_id, turn, role and text.
    """
    rows, convs = rebuilt(turns)
    sequences, ends = collapse(rows, convs)
    paths = prefixes(rows, sequences)
    summed = cut_lineage(paths.groupBy(*_NODE).agg(
        F.min("depth").alias("depth"), F.min("conv").alias("conv"),
        F.sum("weight").alias("n_convs"), F.min("pa").alias("pa"), F.min("pb").alias("pb"),
        F.max("chars").alias("chars")))
    # a sequence is a leaf unless it is a proper prefix of another
    proper = cut_lineage(paths.where("depth < length").select(*_NODE).distinct())
    leaves = cut_lineage(sequences.join(proper, _NODE, "left_anti").select("conv"))
    branches = cut_lineage(paths.select("conv", "depth", *_NODE).join(leaves, "conv"))
    under = cut_lineage(branches.groupBy(*_NODE).agg(
        F.count("*").alias("n_leaves"), F.min("conv").alias("owner")))
    shares = cut_lineage(summed.join(under, _NODE).select(
        *_NODE, "owner", ((F.col("n_convs") - 1) * F.col("chars")).alias("share")))
    # below the topmost node a leaf owns, it owns all of its branch
    owned = branches.join(shares, _NODE).select(
        "conv", "depth", *_NODE, F.when(F.col("owner") == F.col("conv"), F.col("share")).otherwise(
            F.lit(0)).alias("share"))
    owned = cut_lineage(running(cut_lineage(owned), "conv", "depth", ["share"]))
    total = cut_lineage(owned.groupBy("conv").agg(F.sum("share").alias("total")))
    saved = cut_lineage(owned.join(total, "conv").groupBy(*_NODE).agg(F.sum(
        F.col("total") - F.col("up_share") + F.col("share")).alias("saved_tokens")))
    children = cut_lineage(summed.where("pa is not null").groupBy(
        F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(F.count("*").alias("n_children")))
    parents = summed.select(F.col("ka").alias("pa"), F.col("kb").alias("pb"),
                            F.col("conv").alias("parent_conv_id"))
    nothing = F.lit(0).cast("bigint")
    return summed.drop("chars").join(under.drop("owner"), _NODE).join(saved, _NODE).join(
        children, _NODE, "left").join(ends, _NODE, "left").join(
        parents, ["pa", "pb"], "left").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs",
        F.coalesce("n_children", nothing).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
