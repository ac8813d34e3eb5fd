"""Removal of long repeated substrings by bucket-pointer refinement of sampled suffixes.

A byte goes if a 200-byte string that covers it also starts anywhere else, in the same or
another document. The starts of such strings are suffixes; sorting all of them would move
far more than the corpus, so buckets are made and refined in this order:

1. Initial buckets. The start of every string belongs to the bucket of the least hashed
   48-byte gram within it. Equal strings share their bucket, and neighbouring starts
   mostly do too: such a run of starts is one row. The strings of a run that is alone in its
   bucket can only repeat each other, and only if the least gram occurs in it twice.
2. Contexts. A run's context is the text all its strings cover. A context met twice in a
   bucket repeats whole. From buckets with several contexts, or with a gram that occurs
   twice in a run, one copy of each context is fetched.
3. Refinement. Within a bucket's contexts every position gets the rank of its 48-byte gram;
   pairs of ranks, a position's own and that of the position 48, 96 and then 152 further on,
   are sorted and ranked again, each round reusing the ranks of the last. The final ranks
   name 200-byte strings. Buckets of many contexts are dealt out over several units; what
   meets only across units is settled by grouping strings by hash, but only those whose
   core, the part near the least gram, occurs in another unit.

Texts are moved twice, and only those of documents that a bounded bit table
(`common.among`) does not rule out: once for contexts, once to cut the removed bytes out.

A null or empty text has no bytes and loses none; texts under 200 bytes stay whole. Repeated
rows are copies of one another, so all of their bytes go if they have 200. A null id is
an id like any other. An empty table gives an empty table. Very long texts are read in slabs,
other columns are ignored. Hashes are 64 bits; strings are told apart by two of them.
"""

import hashlib

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.llm.common import among, ranges_index, schema_with, small_batches, text_bytes
from tillworks.session import cut_lineage

LENGTH = 200
GRAM = 48
UNIT_CONTEXTS = 256
CORE_STEP = 16
_STARTS = LENGTH - GRAM + 1  # grams in a string
_RUN_LIMIT = 2 * _STARTS  # longer runs, in periodic text, are cut
_SLAB = 1 << 20
_GROUP_BYTES = 1 << 18


def _powers(base, count):
    return np.multiply.accumulate(np.concatenate(
        [np.ones(1, np.uint64), np.full(count, base, np.uint64)]))


class _Hashing:
    """Polynomial hashes of substrings, modulo 2**64, from running sums."""

    BASE = 0x9E3779B97F4A7C15
    BYTES = np.random.default_rng(200).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + \
        np.uint64(1)
    _tables = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def __init__(self, data):
        n = len(data)
        cls = type(self)
        if len(cls._tables[0]) <= n:
            size = max(1 << 16, 1 << (n + 1).bit_length())
            cls._tables = (_powers(cls.BASE, size), _powers(pow(cls.BASE, -1, 1 << 64), size))
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(cls.BYTES[data] * cls._tables[0][:n], out=self._sums[1:])

    def of(self, starts, ends):
        x = (self._sums[ends] - self._sums[starts]) * self._tables[1][starts]
        return _mixed(x)

    def grams(self, size):
        sums = self._sums
        return _mixed((sums[size:] - sums[:-size]) * self._tables[1][:len(sums) - size])


def _mixed(x):
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _sliding_least(values, width):
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def _tied(grams, first, count, bucket):
    """Whether a run's least gram occurs twice in it: then its strings may repeat in the run."""
    # a small table rules out nearly all positions
    known = np.zeros(1 << 16, bool)
    known[(bucket & np.uint64(0xFFFF)).astype(np.int64)] = True
    at = np.flatnonzero(known[(grams & np.uint64(0xFFFF)).astype(np.int64)])
    values, number = np.unique(bucket, return_inverse=True)
    own = np.searchsorted(values, grams[at])
    hit = values[np.minimum(own, len(values) - 1)] == grams[at]
    places = np.sort(own[hit] * (len(grams) + 1) + at[hit])
    base = number.reshape(-1) * (len(grams) + 1) + first
    return np.searchsorted(places, base + count + _STARTS - 1) - np.searchsorted(places, base) > 1


def runs_of(data):
    """(first start, starts, bucket, context, tied) arrays of a text given as uint8 array."""
    parts = [[], [], [], [], []]
    for base in range(0, max(0, len(data) - LENGTH + 1), _SLAB):
        slab = data[base:base + _SLAB + LENGTH - 1]
        hashing = _Hashing(slab)
        grams = hashing.grams(GRAM)
        least = _sliding_least(grams, _STARTS)
        first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        count = np.diff(np.append(first, len(least)))
        if count.max() > _RUN_LIMIT:
            pieces = -(-count // _RUN_LIMIT)
            end = np.repeat(first + count, pieces)
            first = np.repeat(first, pieces) + _RUN_LIMIT * ranges_index(
                np.zeros(len(pieces)), pieces)
            count = np.minimum(_RUN_LIMIT, end - first)
        context = hashing.of(first, first + count - 1 + LENGTH) + count.astype(np.uint64)
        for part, x in zip(parts, (first + base, count, least[first].view(np.int64),
                                   context.view(np.int64),
                                   _tied(grams, first, count, least[first]))):
            part.append(x)
    return [np.concatenate(p) if p else np.empty(0, np.int64) for p in parts]


def _keyed(documents, id_col, text_col):
    """row (all columns but the text), text and a key that tells apart all but equal rows."""
    others = [F.col(f"`{c}`") for c in documents.columns if c != text_col]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return documents.select(F.struct(*others).alias("row"), text.alias("text"),
                            F.col(text_col).isNull().alias("missing"),
                            F.xxhash64(F.col(id_col).cast("bigint"), text).alias("key"))


def _find_runs(batches):
    for batch in batches:
        keys, found = [], []
        for key, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
            if len(text) >= LENGTH:
                found.append(runs_of(np.frombuffer(text, np.uint8)))
                keys.append(np.full(len(found[-1][0]), key, np.int64))
        if found:
            first, count, bucket, context, tied = (np.concatenate(x) for x in zip(*found))
            yield pa.record_batch(
                [np.concatenate(keys), first.astype(np.int64), count.astype(np.int32), bucket,
                 context, tied], ["key", "first", "starts", "bucket", "context", "tied"])


def _fetch_contexts(batches):
    """Cut the requested contexts out of each text."""
    for batch in batches:
        out = []
        for text, wanted in zip(text_bytes(batch.column(0)), batch.column(1).to_pylist()):
            for w in wanted:
                end = w["first"] + w["starts"] - 1 + LENGTH
                out.append((w["bucket"], w["context"], w["copies"], w["unit"], w["units"],
                            text[w["first"]:end]))
        if out:
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(zip(*out), (
                    pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                ["bucket", "context", "copies", "unit", "units", "bytes"])


def _changes(*columns):
    """Where rows of sorted columns differ from the row before."""
    if not len(columns[0]):
        return np.empty(0, bool)
    return np.append(True, np.any([np.diff(c) != 0 for c in columns], axis=0))


def _ranked(*ids):
    """Ranks of tuples of ids: equal tuples share a rank, and ranks follow their order."""
    key = ids[0].astype(np.int64)
    for more in ids[1:]:
        key = (key << 32) | more
    return np.unique(key, return_inverse=True)[1].reshape(-1)


def refine(contexts, groups, copies, buckets):
    """Which strings of the contexts of each group repeat within the group.

    ``contexts`` are byte strings of 200 bytes at least, ``groups`` their groups' numbers,
    ``copies`` how often each occurs and ``buckets`` their buckets. Gives (context index,
    start) of the strings, whether each repeats, and each string's hash and core.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    begin = np.cumsum(sizes) - sizes
    hashing = _Hashing(np.frombuffer(b"".join(contexts), np.uint8))
    rank = np.zeros(int(sizes.sum()), np.int64)

    def positions(width):
        count = sizes - width + 1
        return ranges_index(begin, count), count

    at, count = positions(GRAM)
    hashes = hashing.of(at, at + GRAM)
    least = at[hashes == np.repeat(buckets.view(np.uint64), count)]
    grams = np.unique(hashes, return_inverse=True)[1].reshape(-1)
    rank[at] = _ranked(np.repeat(groups, count), grams)
    gram_rank, width = rank.copy(), GRAM
    while 2 * width <= LENGTH:  # twice the width: the ranks of the last round, and further on
        at, count = positions(2 * width)
        rank[at] = _ranked(rank[at], rank[at + width])
        width *= 2
    at, count = positions(LENGTH)
    if width < LENGTH:
        final = _ranked(rank[at], gram_rank[at + LENGTH - GRAM])
    else:
        final = rank[at]
    owner = np.repeat(np.arange(len(contexts)), count)
    met = np.bincount(final, weights=np.asarray(copies, float)[owner])
    # a core is the part that a string shares with all that hold the least gram about there
    anchor = least[np.searchsorted(least, at)]
    step = (anchor - at) // CORE_STEP
    core = hashing.of(anchor - step * CORE_STEP, anchor - step * CORE_STEP + LENGTH - CORE_STEP + 1)
    core += step.astype(np.uint64) * np.uint64(_Hashing.BASE)
    return (owner, at - begin[owner], met[final] > 1,
            hashing.of(at, at + LENGTH).view(np.int64), core.view(np.int64))


def _refine_units(batches):
    """Read units in consecutive rows and settle each.

    Rows with bucket, context, first, last: the strings from first to last repeat within the
    unit. Rows with bucket, core, items, from buckets of several units: strings with that
    core, each with its context and start if alone in the unit, or once without if not.
    """
    names = ["bucket", "context", "first", "last", "core", "items"]
    item = pa.struct([("context", pa.int64()), ("start", pa.int32()), ("string", pa.int64())])

    def settle(rows):
        bucket, context, copies, unit, units, contexts = zip(*rows)
        bucket, context, unit, units = (np.array(x, np.int64) for x in (bucket, context, unit,
                                                                        units))
        group = np.cumsum(np.append(False, (np.diff(bucket) != 0) | (np.diff(unit) != 0)))
        owner, start, repeats, string, core = refine(contexts, group, copies, bucket)
        follows = np.append(False, (owner[1:] == owner[:-1]) & repeats[:-1])
        first = np.flatnonzero(repeats & ~follows)
        last = np.flatnonzero(repeats & ~np.append(follows[1:] & repeats[1:], False))
        own, n = owner[first], len(first)
        yield pa.record_batch(
            [bucket[own], context[own], start[first].astype(np.int32),
             start[last].astype(np.int32), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(item))],
            names)
        several = units[owner] > 1
        if not several.any():
            return
        shown = np.flatnonzero(several & repeats)
        shown = shown[np.lexsort((string[shown], group[owner[shown]]))]
        shown = shown[_changes(string[shown], group[owner[shown]])]
        strings = np.concatenate([np.flatnonzero(several & ~repeats), shown])
        strings = strings[np.lexsort((core[strings], group[owner[strings]]))]
        new = np.flatnonzero(_changes(core[strings], group[owner[strings]]))
        known = repeats[strings]
        items = pa.StructArray.from_arrays(
            [pa.array(context[owner[strings]], mask=known),
             pa.array(start[strings].astype(np.int32), mask=known), pa.array(string[strings])],
            fields=list(item))
        one, n = strings[new], len(new)
        none = pa.nulls(n, pa.int32())
        yield pa.record_batch(
            [bucket[owner[one]], pa.nulls(n, pa.int64()), none, none, core[one],
             pa.ListArray.from_arrays(pa.array(np.append(new, len(strings)).astype(np.int32)),
                                      items)], names)

    waiting, size = [], 0
    for batch in _once(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if size > _GROUP_BYTES and (row[0], row[3]) != (waiting[-1][0], waiting[-1][3]):
                yield from settle(waiting)
                waiting, size = [], 0
            waiting.append(row)
            size += len(row[5])
    if waiting:
        yield from settle(waiting)


def spans(keyed: DataFrame) -> DataFrame:
    """key and spans, array<struct<begin,end>>, of the documents that lose bytes.

    ``keyed`` has key and text. Spans may overlap; each is covered by repeated strings.
    """
    spark = keyed.sparkSession
    small_batches(spark)
    runs = cut_lineage(keyed.select("key", "text").mapInArrow(
        _find_runs, "key bigint, first bigint, starts int, bucket bigint, context bigint, "
                    "tied boolean"))
    # one row per bucket, written, so that the join below may split a bucket
    shared = cut_lineage(runs.groupBy("bucket").agg(
        F.count("*").alias("n"), F.bool_or("tied").alias("tied"))
        .where("n > 1 or tied").select("bucket"))
    rows = cut_lineage(among(runs, "bucket", shared).join(shared, "bucket"))
    contexts = cut_lineage(rows.groupBy("bucket", "context").agg(
        F.count("*").alias("copies"), F.min(F.struct("key", "first")).alias("one"),
        F.first("starts").alias("starts"), F.bool_or("tied").alias("tied")))
    mixed = cut_lineage(contexts.groupBy("bucket").agg(
        F.count("*").alias("n"), F.bool_or("tied").alias("tied")).where("n > 1 or tied").drop(
        "tied"))
    wanted = contexts.join(mixed, "bucket").withColumn(
        "units", F.ceil(F.col("n") / UNIT_CONTEXTS).cast("int")).withColumn(
        "unit", F.expr("int(pmod(xxhash64(context), units))"))
    requests = cut_lineage(wanted.groupBy(F.col("one.key").alias("key")).agg(F.collect_list(
        F.struct(F.col("one.first").alias("first"), "starts", "bucket", "context", "copies",
                 "unit", "units")).alias("wanted")))
    fetched = among(keyed.select("key", "text"), "key", requests).join(requests, "key").select(
        "text", "wanted").mapInArrow(
        _fetch_contexts, "bucket bigint, context bigint, copies bigint, unit int, units int, "
                         "bytes binary")
    # a context is fetched once even where whole rows are repeated
    order = ["bucket", "unit", "context"]
    settled = cut_lineage(
        fetched.repartition(F.col("bucket"), F.col("unit")).sortWithinPartitions(*order)
        .mapInArrow(_refine_units,
                    "bucket bigint, context bigint, first int, last int, core bigint, "
                    "items array<struct<context: bigint, start: int, string: bigint>>"))
    # a string can only repeat in another unit if its core occurs there
    cores = settled.where("core is not null").select("bucket", "core", "items")
    met = cut_lineage(cores.groupBy("bucket", "core").agg(F.count("*").alias("n")).where(
        "n > 1").select("bucket", "core"))
    named = cut_lineage(cores.join(met, ["bucket", "core"]).select(
        "bucket", F.explode("items").alias("item")).select("bucket", "item.*"))
    across = cut_lineage(named.groupBy("bucket", "string").agg(
        F.count("*").alias("n")).where("n > 1").select("bucket", "string"))
    settled_part = F.struct(F.col("first").alias("from"), F.col("last").alias("to"))
    across_part = F.struct(F.col("start").alias("from"), F.col("start").alias("to"))
    partly = settled.where("core is null").select(
        "bucket", "context", settled_part.alias("part")).unionByName(
        named.where("context is not null").join(across, ["bucket", "string"]).select(
            "bucket", "context", across_part.alias("part"))).groupBy("bucket", "context").agg(
        F.collect_set("part").alias("parts"))
    whole = F.array(F.struct(F.lit(0).alias("from"), (F.col("starts") - 1).alias("to")))
    repeated = cut_lineage(
        contexts.select("bucket", "context", "copies", "starts").join(
            partly, ["bucket", "context"], "left")
        .where("copies > 1 or parts is not null")
        .select("bucket", "context", F.when(F.col("copies") > 1, whole).otherwise(
            F.col("parts")).alias("parts")))
    marked = rows.join(repeated, ["bucket", "context"]).select("key", F.explode(F.transform(
        "parts", lambda p: F.struct((F.col("first") + p["from"]).alias("begin"),
                                    (F.col("first") + p["to"] + LENGTH).alias("end")))
    ).alias("span"))
    return cut_lineage(marked.groupBy("key").agg(F.collect_set("span").alias("spans")))


def _once(batches):
    """Rows sorted by bucket, unit and context, each context once."""
    last = None
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        keep = [k != before for k, before in zip(keys, [last, *keys[:-1]])]
        if keys:
            last = keys[-1]
        yield batch.filter(pa.array(keep, pa.bool_()))


def merged(found):
    """Overlapping and touching spans joined: (begins, ends)."""
    pairs = np.array(sorted((s["begin"], s["end"]) for s in found), np.int64).reshape(-1, 2)
    reach = np.maximum.accumulate(pairs[:, 1])
    new = np.append(True, pairs[1:, 0] > reach[:-1])
    return pairs[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(pairs) - 1)]


def remove_repeats(documents: DataFrame, id_col="doc_id", text_col="text",
                   as_text=False) -> DataFrame:
    """One row per row: row (struct of the other columns), missing (the text was null),
    n_bytes, n_removed, n_spans and kept (binary, or text without cut characters)."""
    keyed = _keyed(documents, id_col, text_col)
    found = spans(keyed)
    names = ["n_bytes", "n_removed", "n_spans", "kept"]
    schema = schema_with(keyed.select("row", "missing"), n_bytes="bigint", n_removed="bigint",
                         n_spans="bigint", kept="string" if as_text else "binary")

    def cut(batches):
        for batch in batches:
            out = []
            for text, own in zip(text_bytes(batch.column(2)), batch.column(3).to_pylist()):
                begins, ends = merged(own) if own else (np.empty(0, int), np.empty(0, int))
                begins, ends = begins.tolist(), ends.tolist()
                kept = b"".join(text[a:b] for a, b in zip([0, *ends], [*begins, len(text)]))
                out.append((len(text), len(text) - len(kept), len(begins),
                            kept.decode(errors="ignore") if as_text else kept))
            if out:
                yield pa.record_batch(
                    [batch.column(0), batch.column(1),
                     *(pa.array(c, t) for c, t in zip(zip(*out), (
                         pa.int64(), pa.int64(), pa.int64(),
                         pa.string() if as_text else pa.binary())))],
                    ["row", "missing", *names])

    touched = among(keyed, "key", found).join(found, "key", "left").select(
        "row", "missing", "text", "spans").mapInArrow(cut, schema)
    whole = among(keyed, "key", found, keep=False).select(
        "row", "missing", F.octet_length("text").cast("bigint").alias("n_bytes"),
        F.lit(0).cast("bigint").alias("n_removed"), F.lit(0).cast("bigint").alias("n_spans"),
        F.col("text").cast("string" if as_text else "binary").alias("kept"))
    return touched.unionByName(whole)


def digests(documents: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the hash of the kept bytes."""
    only = documents.select(F.col(id_col).cast("bigint").alias("doc_id"),
                            F.col(text_col).alias("text"))
    return remove_repeats(only).select("row.doc_id", "n_bytes", "n_removed", "n_spans",
                                       F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(documents: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The documents with their texts cut; a null text stays null.

    A cut may fall within a character; what is left of such a character goes too.
    """
    cut = remove_repeats(documents, id_col, text_col, as_text=True)
    text = F.when(~F.col("missing"), F.col("kept"))
    return cut.select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`")
                        for c in documents.columns])


def brute_force(texts):
    """The same for a list of byte strings, in memory: (n_bytes, n_removed, n_spans, sha256)."""
    seen = {}
    for text in texts:
        for i in range(len(text) - LENGTH + 1):
            seen[text[i:i + LENGTH]] = seen.get(text[i:i + LENGTH], 0) + 1
    out = []
    for text in texts:
        gone = bytearray(len(text))
        for i in range(len(text) - LENGTH + 1):
            if seen[text[i:i + LENGTH]] > 1:
                gone[i:i + LENGTH] = b"\1" * LENGTH
        kept = bytes(b for b, g in zip(text, gone) if not g)
        out.append((len(text), sum(gone), sum(g and not before for g, before in zip(
            gone, [0, *gone[:-1]])), hashlib.sha256(kept).hexdigest()))
    return out
