"""SimHash near-duplicates found by pigeonring filtering.

A fingerprint's 64 bits are cut into five segments in a ring. If two fingerprints differ
in at most four bits, there is a segment from which every chain of consecutive segments
stays within its share of the differences: at most 0, 1, 2, 3, 4 in chains of one to
five segments. The first two conditions are an equality join: a fingerprint is at home
in the bucket of (segment, next segment) for each of the five starts, and visits the
buckets whose next segment lacks one of its set bits. Longer chains and then the full
distance are checked only for those who meet in a bucket.

Documents with one fingerprint are one node, so exact copies cost nothing. A bucket is
dealt out in blocks of bounded size; each pair of blocks is one unit of work, which
yields a star for every group it connects instead of all pairs. So a group of near copies of any
size neither meets in one task nor gives a square number of rows, and no link is lost.

A null or empty text has fingerprint zero and links like any other. Repeated rows share a
component. Null ids are left out of the smallest id; a component of null ids alone has a
null id. An empty table gives an empty table. Other columns are ignored.
"""

import numpy as np
import pyarrow as pa
import xxhash

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.llm.common import among, schema_with, small_batches, text_bytes
from tillworks.llm.components import components
from tillworks.session import cut_lineage

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
# widths of the ring's segments, from the lowest bit
SEGMENTS = (13, 13, 13, 13, 12)
BLOCK = 512
_STARTS = np.cumsum((0, *SEGMENTS))[:-1].tolist()
_HASHES_AT_ONCE = 1 << 16


def fingerprint(text: bytes, words=SHINGLE_WORDS) -> int:
    """The SimHash of a text given as UTF-8 bytes."""
    tokens = text.lower().split()  # as bytes: lowers A-Z, splits at ASCII white space
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.append(0, ends[:-1] + 1)
    if len(tokens) >= words:
        starts, ends = starts[:len(tokens) - words + 1], ends[words - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones = np.zeros(64, np.int64)
    hashed = xxhash.xxh64_intdigest
    for i in range(0, len(starts), _HASHES_AT_ONCE):
        values = np.array([hashed(joined[a:b], SEED) for a, b in zip(
            starts[i:i + _HASHES_AT_ONCE].tolist(), ends[i:i + _HASHES_AT_ONCE].tolist())], "<u8")
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(bits.view("<i8")[0])


def with_print(rows: DataFrame, words=SHINGLE_WORDS) -> DataFrame:
    """The rows with a signed bigint, print, in place of their last column, a text."""
    small_batches(rows.sparkSession)
    kept = rows.columns[:-1]

    def run(batches):
        for batch in batches:
            prints = [fingerprint(t or b"", words) for t in text_bytes(batch.columns[-1])]
            yield pa.record_batch([*batch.columns[:-1], pa.array(prints, pa.int64())],
                                  [*kept, "print"])

    return rows.mapInArrow(run, schema_with(rows.select(*kept), print="bigint"))


def _segment(i):
    return f"(shiftrightunsigned(print, {_STARTS[i]}) & {(1 << SEGMENTS[i]) - 1}L)"


def _meetings(prints: DataFrame) -> DataFrame:
    """bucket, print, home: where each fingerprint is at home and where it visits."""
    places = []
    for i in range(5):
        j = (i + 1) % 5
        home = f"({i}L << 40 | {_segment(i)} << 16 | {_segment(j)})"
        places.append(f"named_struct('bucket', {home}, 'home', true)")
        places += [f"if({_segment(j)} & {1 << b}L != 0, named_struct('bucket', {home} - {1 << b}L, "
                   f"'home', false), null)" for b in range(SEGMENTS[j])]
    return (prints.select("print", F.explode(F.expr(f"array({', '.join(places)})")).alias("at"))
            .where("at is not null").select("at.bucket", "print", "at.home"))


def _units(prints: DataFrame) -> DataFrame:
    """Rows of the work units: bucket, kind, left, right, side, print.

    Kind 0 compares home blocks, kind 1 a home block with a block of visitors.
    """
    # one row per bucket in which anyone meets, written, so that the join may split a bucket
    meets = cut_lineage(
        _meetings(prints).groupBy("bucket")
        .agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("visits"))
        .where("homes > 0 and homes + visits > 1")
        .select("bucket", F.ceil(F.col("homes") / BLOCK).cast("int").alias("home_blocks"),
                F.ceil(F.col("visits") / BLOCK).cast("int").alias("visit_blocks")))
    rows = _meetings(prints).join(meets, "bucket").selectExpr(
        "*", "int(pmod(xxhash64(print, bucket), if(home, home_blocks, visit_blocks))) as own")
    unit = "named_struct('kind', {}, 'left', {}, 'right', {}, 'side', {})"
    at_home = unit.format("0", "least(x, own)", "greatest(x, own)", "if(own <= x, 0, 1)")
    with_visits = unit.format("1", "own", "x", "0")
    visiting = unit.format("1", "x", "own", "1")
    blocks = "transform(filter(sequence(0, greatest({0}, 1) - 1), x -> x < {0}), x -> {1})"
    return rows.selectExpr(
        "bucket", "print",
        "explode(if(home, concat(" + blocks.format("home_blocks", at_home) + ", "
        + blocks.format("visit_blocks", with_visits) + "), "
        + blocks.format("home_blocks", visiting) + ")) as unit",
    ).select("bucket", "unit.kind", "unit.left", "unit.right", "unit.side", "print")


def _masks(start):
    """For a start segment: the bits of chains of 3 and 4 segments, with their budgets."""
    def bits(count):
        total = 0
        for k in range(count):
            i = (start + k) % 5
            total |= ((1 << SEGMENTS[i]) - 1) << _STARTS[i]
        return np.uint64(total)
    return (bits(3), 2), (bits(4), 3)


_MASKS = [_masks(i) for i in range(5)]


def _stars(start, left, right):
    """Links (print, least print of its group) among left x right, or within left."""
    values = left if right is None else np.concatenate([left, right])
    differ = left[:, None] ^ (left if right is None else right)[None, :]
    near = np.ones(differ.shape, bool)
    for mask, budget in _MASKS[start]:
        near &= np.bitwise_count(differ & mask) <= budget
    rows, columns = np.nonzero(near)
    close = np.bitwise_count(differ[rows, columns]) <= MAX_BITS
    rows, columns = rows[close], columns[close] + (0 if right is None else len(left))
    signed = values.view(np.int64)
    least = signed.copy()
    while True:
        new = least.copy()
        np.minimum.at(new, rows, least[columns])
        np.minimum.at(new, columns, least[rows])
        if (new == least).all():
            break
        least = new
    moved = np.flatnonzero(least != signed)
    return signed[moved], least[moved]


def _link_units(batches):
    """Read units, each in consecutive rows, and give the links found in each."""
    def links(table):
        bucket, kind, left, right, side, prints = table
        change = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(kind) != 0)
                                | (np.diff(left) != 0) | (np.diff(right) != 0)) + 1
        a, b = [], []
        for first, last in zip(np.append(0, change), np.append(change, len(bucket))):
            if last - first < 2:
                continue
            values, own = prints[first:last].view(np.uint64), side[first:last] == 0
            within = kind[first] == 0 and left[first] == right[first]
            if not within and (own.all() or not own.any()):
                continue
            found = _stars(int(bucket[first] >> 40), values if within else values[own],
                           None if within else values[~own])
            a.append(found[0])
            b.append(found[1])
        if a:
            yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))],
                                  ["a", "b"])

    rest = None
    for batch in batches:
        table = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            table = [np.concatenate(x) for x in zip(rest, table)]
        if not len(table[0]):
            continue
        same = np.ones(len(table[0]), bool)
        for column in table[:4]:
            same &= column == column[-1]
        cut = np.flatnonzero(~same)
        cut = cut[-1] + 1 if len(cut) else 0
        yield from links([c[:cut] for c in table])
        rest = [c[cut:] for c in table]
    if rest is not None:
        yield from links(rest)


def near_links(prints: DataFrame) -> DataFrame:
    """Links between distinct fingerprints that connect whatever is within the distance."""
    small_batches(prints.sparkSession, 10_000)
    unit = ["bucket", "kind", "left", "right"]
    units = _units(prints)
    return (units.repartition(*[F.col(c) for c in unit]).sortWithinPartitions(*unit)
            .mapInArrow(_link_units, "a bigint, b bigint"))


def groups(prints: DataFrame) -> DataFrame:
    """One row per fingerprint: print and the root of its component, a fingerprint too."""
    nodes = cut_lineage(prints.select("print").distinct())
    roots = components(cut_lineage(near_links(nodes)))
    return cut_lineage(nodes.join(roots, nodes["print"] == roots["node"], "left").select(
        "print", F.coalesce("root", "print").alias("root")))


def near_duplicates(documents: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row per row."""
    prints = cut_lineage(with_print(documents.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))))
    rooted = groups(prints)
    # one row per fingerprint before they meet their component
    least = prints.groupBy("print").agg(F.min("doc_id").alias("least")).join(rooted, "print")
    # written, so that the join below may split a component of many fingerprints
    component = cut_lineage(least.groupBy("root").agg(F.min("least").alias("component_id")))
    by_print = cut_lineage(rooted.join(component, "root").select("print", "component_id"))
    return prints.join(by_print, "print").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The documents with one row of each component: that of the smallest id.

    Rows of one id are told apart by a hash of all columns; equal rows count as one.
    """
    names = documents.columns
    own = F.xxhash64(*[F.col(f"`{c}`") for c in names])
    rows = documents.select(F.col(id_col).cast("bigint").alias("id"), own.alias("own"),
                            F.col(text_col).cast("string").alias("text"))
    prints = cut_lineage(with_print(rows))
    first = F.struct(F.col("id").isNull().alias("missing"), F.col("id"), F.col("own"))
    least = prints.groupBy("print").agg(F.min(first).alias("least"))
    chosen = least.join(groups(prints), "print").groupBy("root").agg(F.min("least").alias("least"))
    winners = chosen.select(F.col("least.own").alias("own"), F.lit(True).alias("stays"))
    copies = prints.groupBy("own").agg(F.count("*").alias("copies"))
    # all but the rows that stay as they are: few, so few texts are moved to join them
    special = cut_lineage(copies.join(winners, "own", "left").where(
        "stays is null or copies > 1").select("own", F.coalesce("stays", F.lit(False)).alias(
            "stays")))
    rest = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
                            own.alias("own"))
    plain = among(rest, "own", special, keep=False)
    joined = among(rest, "own", special).join(special, "own", "left")
    return plain.select("row.*").unionByName(
        joined.where("stays is null").select("row.*")).unionByName(
        joined.where("stays").dropDuplicates(["own"]).select("row.*"))
