"""Ranked lexical search over K2-treaps of the term-document grid.

A term is a maximal run of a-z, 0-9 and non-ASCII characters after A-Z are lower-cased. The
score of a document for an item is the sum over the item's terms, once each, of w * impact with
impact = (1000000000 * tf) div (1000 * tf + 8 * m); w and m follow from counts over all documents.

Documents are indexed in shards of at most ``SHARD_DOCUMENTS``. A shard's grid has a row per term and
a column per document. Its treap is a quadtree over the grid: a node keeps the largest impact in its
cell and four bits saying which quarters are not empty; empty cells are not stored, and a
child's number follows from counting bits, so there are no pointers. For an item the row paths of
its terms go down together. The open states are ranges of documents, each with the cells
where the terms' rows cross it; w times the cells' maxima add up to a bound on every score in the
range. The ranges of the highest bounds are halved first, some at a time, and a range whose bound is
under the item's k-th score so far is left out; equal bounds are visited, so that ties go to
the smaller id. The k-th scores pass from shard to shard of a task. The result is exact, up to
64-bit hashes of terms.

Items come in blocks of about ``BLOCK_TERMS`` terms, each broadcast to all shards. Terms that no
item asks for are kept out of the grid by a bit table of fixed size; where items ask for so
many terms that it fills up, the grid only gets larger.

Null texts have no terms. Rows of one item id are one item with the terms of all its rows, a null
item id is an item too. Every row of documents is a candidate of its own, repeated ids and rows
included; a null document id comes before all others among equal scores (and so does
-2^63, which is read as null). Items and documents without terms give no rows, nor do
empty tables. Other columns are ignored.
"""

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillworks.llm.common import BITS, ranges_index, small_batches, text_bytes
from tillworks.session import cut_lineage

SHARD_DOCUMENTS = 2048
SHARD_POINTS = 1 << 20
BLOCK_TERMS = 1 << 17
ITEMS_AT_ONCE = 64
FIRST_BEAM = 16
KNOWN_WORDS = 1 << 19
BATCH_BYTES = 16 << 20
NULL_ID = np.iinfo(np.int64).min

_TERM_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_UPPER = bytes(range(65, 91))
# bytes of terms stay, capitals become small, all others blank
_PLAIN = bytes(c if c in _TERM_BYTES else c + 32 if c in _UPPER else 32 for c in range(256))
_ONES = np.array([bin(i).count("1") for i in range(16)], np.int64)


def terms_of(text: bytes) -> list:
    return text.translate(_PLAIN).split()


def term_hash(word: bytes) -> int:
    value = xxhash.xxh64_intdigest(word)
    return value - (1 << 64) if value >> 63 else value


def _lists(values, lengths, kind):
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def item_terms(items: DataFrame) -> DataFrame:
    """The distinct (item_id, term) pairs of the items, terms as hashes."""
    small_batches(items.sparkSession)

    def split(batches):
        for batch in batches:
            found = [sorted({term_hash(w) for w in terms_of(t or b"")})
                     for t in text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), _lists([x for f in found for x in f],
                                                 [len(f) for f in found], pa.int64())],
                names=["item_id", "terms"])

    read = items.select(F.col("item_id").cast("bigint").alias("item_id"),
                        F.col("text").cast("string").alias("text"))
    return cut_lineage(read.mapInArrow(split, "item_id bigint, terms array<bigint>").select(
        "item_id", F.explode("terms").alias("term")).distinct())


def bit_table(terms: DataFrame) -> np.ndarray:
    """The terms' places in a table of ``BITS`` bits; at most that many bits reach the driver."""
    bit = F.col("term").bitwiseAND(F.lit(BITS - 1))
    words = terms.select(bit.alias("bit")).groupBy(F.expr("bit div 32").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, int(bit % 32)))").alias("mask")).toArrow()
    table = np.zeros(BITS // 32, np.uint32)
    table[words.column("word").to_numpy()] = words.column("mask").to_numpy().astype(np.uint32)
    return table


def postings(documents: DataFrame, asked: DataFrame) -> DataFrame:
    """doc_id, n, terms, tfs per document; terms are those that may be among the asked ones."""
    spark = documents.sparkSession
    small_batches(spark)
    table = spark.sparkContext.broadcast(bit_table(asked))

    def count(batches):
        bits, known = table.value, {}
        for batch in batches:
            n, lengths, terms, tfs = [], [], [], []
            for text in text_bytes(batch.column("text")):
                words = terms_of(text or b"")
                before = len(terms)
                for word, tf in Counter(words).items():
                    term = known.get(word, 0)
                    if term == 0:
                        term = term_hash(word)
                        bit = term & (BITS - 1)
                        term = term if bits[bit >> 5] >> (bit & 31) & 1 else None
                        if len(known) >= KNOWN_WORDS:
                            known.clear()
                        known[word] = term
                    if term is not None:
                        terms.append(term)
                        tfs.append(tf)
                n.append(len(words))
                lengths.append(len(terms) - before)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()),
                 _lists(terms, lengths, pa.int64()), _lists(tfs, lengths, pa.int64())],
                names=["doc_id", "n", "terms", "tfs"])

    read = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                            F.col("text").cast("string").alias("text"))
    return cut_lineage(read.mapInArrow(
        count, "doc_id bigint, n bigint, terms array<bigint>, tfs array<bigint>"))


def _spread(x):
    """Each bit of x moved to twice its place."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF),
                        (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333),
                        (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def build_treap(rows, columns, impacts, height):
    """Quarter bits of inner nodes and maxima of all nodes, level by level from the root."""
    place = (_spread(rows) << np.uint64(1)) | _spread(columns)
    order = np.argsort(place)
    place, top = place[order], impacts[order]
    masks, maxima = [], [top]
    for _ in range(height):
        quarter = np.left_shift(1, (place & np.uint64(3)).astype(np.int64))
        place = place >> np.uint64(2)
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        masks.append(np.bitwise_or.reduceat(quarter, starts).astype(np.uint8))
        top = np.maximum.reduceat(top, starts)
        place = place[starts]
        maxima.append(top)
    empty = np.zeros(0, np.uint8)
    return np.concatenate(masks[::-1] or [empty]), np.concatenate(maxima[::-1]).astype(np.int32)


def build_index(rows: DataFrame, documents: int, words: int) -> DataFrame:
    """Shards (ids, terms, height, masks, maxima) of rows of ``postings``.

    ``documents`` with a term and their ``words`` are counted over the whole table.
    """
    def shard(ids, n, terms, tfs, lengths):
        terms, tfs = np.concatenate(terms), np.concatenate(tfs)
        # of any size, so in Python's integers
        m = np.array([10 + 90 * x * documents // words for x in n], np.int64)
        columns = np.repeat(np.arange(len(ids)), lengths)
        impacts = 1_000_000_000 * tfs // (1000 * tfs + 8 * m[columns])
        vocabulary, places = np.unique(terms, return_inverse=True)
        height = max(len(vocabulary) - 1, len(ids) - 1).bit_length()
        masks, maxima = build_treap(places, columns, impacts, height)
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(pa.int64())), pa.array([vocabulary.tobytes()], pa.binary()),
             pa.array([height], pa.int32()), pa.array([masks.tobytes()], pa.binary()),
             pa.array([maxima.tobytes()], pa.binary())],
            names=["ids", "terms", "height", "masks", "maxima"])

    def build(batches):
        ids, n, terms, tfs, lengths, points = [], [], [], [], [], 0
        for batch in batches:
            sizes = [batch.column(c) for c in ("terms", "tfs")]
            flat = [c.flatten().to_numpy(zero_copy_only=False) for c in sizes]
            size = np.diff(sizes[0].offsets.to_numpy())
            ends = np.cumsum(size)
            for i, doc, many in zip(range(len(size)), batch.column("doc_id").to_pylist(),
                                    batch.column("n").to_pylist()):
                if not size[i]:
                    continue
                part = slice(ends[i] - size[i], ends[i])
                ids.append(doc), n.append(many), lengths.append(size[i])
                # copies, as the batch goes
                terms.append(flat[0][part].copy()), tfs.append(flat[1][part].copy())
                points += size[i]
                if len(ids) >= SHARD_DOCUMENTS or points >= SHARD_POINTS:
                    yield shard(ids, n, terms, tfs, lengths)
                    ids, n, terms, tfs, lengths, points = [], [], [], [], [], 0
        if ids:
            yield shard(ids, n, terms, tfs, lengths)

    return cut_lineage(rows.where("n > 0").mapInArrow(
        build, "ids array<bigint>, terms binary, height int, masks binary, maxima binary"))


class Best:
    """The best k (score, id) of each of a block's items so far."""

    def __init__(self, items, k):
        self.k, self.bar = k, np.ones(items, np.int64)  # a score under the bar is of no use
        self.item, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def offer(self, item, score, ids):
        item, score, ids = (np.concatenate(x) for x in (
            (self.item, item), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, item))
        item = item[order]
        rank = _rank(item)
        keep = rank < self.k
        self.item, self.score, self.id = item[keep], score[order][keep], ids[order][keep]
        full = rank[keep] == self.k - 1
        self.bar[self.item[full]] = self.score[full]


def _rank(group):
    """The place from 0 of each row in its run of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])[:len(group)])
    return np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))


class _Grown:
    """Arrays of equal length that grow by appending."""

    def __init__(self, **kinds):
        self.size, self.columns = 0, {n: np.zeros(1024, k) for n, k in kinds.items()}

    def __getitem__(self, name):
        return self.columns[name]

    def append(self, **values):
        count = len(next(iter(values.values())))
        for name, new in values.items():
            old = self.columns[name]
            if self.size + count > len(old):
                old = np.resize(old, max(2 * len(old), self.size + count))
                self.columns[name] = old
            old[self.size:self.size + count] = new
        self.size += count
        return np.arange(self.size - count, self.size)


class Treap:
    def __init__(self, ids, height, masks, maxima):
        self.ids, self.height, self.masks, self.maxima = ids, height, masks, maxima
        # children stand in the order of their parents, so counting quarters numbers them
        self.first = 1 + np.cumsum(_ONES[masks]) - _ONES[masks]

    def search(self, item, row, weight, best):
        """Offer ``best`` the documents for (item, row, weight) of asked terms, sorted by item."""
        ranges = _Grown(item=np.int64, level=np.int32, column=np.int64, bound=np.int64,
                        start=np.int64, length=np.int64)
        cells = _Grown(node=np.int64, asked=np.int64)

        def put(owner, node, asked, item_of, level, column):
            """New ranges from cells (sorted by owner, which indexes the last three)."""
            sums = np.concatenate([[0], np.cumsum(weight[asked] * self.maxima[node])])
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])[:len(owner)])
            ends = np.append(starts[1:], len(owner))
            bound = sums[ends] - sums[starts]
            of = owner[starts]
            keep = bound >= best.bar[item_of[of]]
            starts, lengths, of = starts[keep], (ends - starts)[keep], of[keep]
            inside = ranges_index(starts, lengths)
            at = cells.append(node=node[inside], asked=asked[inside])
            begin = (at[0] if len(at) else 0) + np.cumsum(lengths) - lengths
            return ranges.append(item=item_of[of], level=level[of], column=column[of],
                                 bound=bound[keep], start=begin, length=lengths)

        def halve(chosen):
            lengths = ranges["length"][chosen]
            at = ranges_index(ranges["start"][chosen], lengths)
            owner = np.repeat(np.arange(len(chosen)), lengths)
            node, asked = cells["node"][at], cells["asked"][at]
            items, level = ranges["item"][chosen], ranges["level"][chosen]
            mask = self.masks[node].astype(np.int64)
            upper = (row[asked] >> (self.height - 1 - level[owner])) & 1
            made = []
            for side in (0, 1):
                quarter = 2 * upper + side
                has = np.flatnonzero((mask >> quarter) & 1)
                earlier = mask[has] & ((1 << quarter[has]) - 1)
                made.append(put(owner[has], self.first[node[has]] + _ONES[earlier], asked[has],
                                items, level + 1, 2 * ranges["column"][chosen] + side))
            return np.concatenate(made)

        def split(found, beam):
            """Of each item the ``beam`` ranges of the highest bounds, and the rest."""
            order = np.lexsort((-ranges["bound"][found], ranges["item"][found]))
            found = found[order]
            first = _rank(ranges["item"][found]) < beam
            return found[first], found[~first]

        items = np.unique(item)
        nothing = np.zeros(best.bar.shape[0], np.int64)
        waiting = put(item, np.zeros(len(item), np.int64), np.arange(len(item)),
                      np.arange(len(best.bar)), nothing.astype(np.int32), nothing)
        beam = FIRST_BEAM
        while len(waiting) and len(items):
            chosen, waiting = split(waiting, beam)
            left = [waiting]
            while len(chosen):
                done = ranges["level"][chosen] == self.height
                if done.any():
                    leaf = chosen[done]
                    best.offer(ranges["item"][leaf], ranges["bound"][leaf],
                               self.ids[ranges["column"][leaf]])
                chosen, later = split(halve(chosen[~done]), beam)
                left.append(later)
            waiting = np.concatenate(left)
            waiting = waiting[ranges["bound"][waiting] >= best.bar[ranges["item"][waiting]]]
            beam *= 4


def search_block(index: DataFrame, block: pa.Table, k: int) -> DataFrame:
    """item_id, doc_id, score: each task's best k for the items (item_id, term, w) of a block."""
    spark = index.sparkSession
    small_batches(spark)
    # blobs of a shard: few rows at a time
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    block = block.sort_by([("item_id", "ascending")])
    ids = block.column("item_id").combine_chunks()
    item = np.unique(ids.fill_null(NULL_ID).to_numpy(), return_inverse=True)
    asked = spark.sparkContext.broadcast((
        item[0], item[1], block.column("term").to_numpy(), block.column("w").to_numpy()))

    def find(batches):
        names, item, term, weight = asked.value
        order = np.argsort(item, kind="stable")
        item, term, weight = item[order], term[order], weight[order]
        best = Best(len(names), k)
        for batch in batches:
            for i in range(batch.num_rows):
                vocabulary, masks, maxima = (
                    np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (
                        ("terms", np.int64), ("masks", np.uint8), ("maxima", np.int32)))
                docs = batch.column("ids")[i].values.fill_null(NULL_ID).to_numpy()
                treap = Treap(docs, batch.column("height")[i].as_py(), masks, maxima.astype(np.int64))
                row = np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1)
                here = np.flatnonzero(vocabulary[row] == term)
                for low in range(0, len(names), ITEMS_AT_ONCE):
                    a, b = np.searchsorted(item[here], [low, low + ITEMS_AT_ONCE])
                    some = here[a:b]
                    if len(some):
                        treap.search(item[some], row[some], weight[some], best)
        null = lambda x: pa.array(x, pa.int64(), mask=x == NULL_ID)
        yield pa.RecordBatch.from_arrays(
            [null(names[best.item]), null(best.id), pa.array(best.score)],
            names=["item_id", "doc_id", "score"])

    return cut_lineage(index.mapInArrow(find, "item_id bigint, doc_id bigint, score bigint"))


def rank(documents: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the best k documents of each item.

    ``documents`` has doc_id and text, ``items`` item_id and text.
    """
    terms = item_terms(items)
    rows = postings(documents, terms)
    size = rows.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("words")).first()
    n = size["documents"]
    counted = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(
        F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2 * n + 2) / (2 * F.col("df") + 1))).cast("bigint")
    weighted = cut_lineage(terms.select("term").distinct().join(counted, "term").select(
        "term", weight.alias("w")).where("w > 0"))
    asked = terms.join(weighted, "term")
    blocks = max(1, -(-asked.count() // BLOCK_TERMS))
    asked = cut_lineage(asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))))
    index = build_index(rows, n, size["words"] or 1)
    found = [search_block(index, asked.where(F.col("block") == b).select(
        "item_id", "term", "w").toArrow(), k) for b in range(blocks)]
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return reduce(DataFrame.unionByName, found).withColumn(
        "rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "item_id", "rank", "doc_id", "score")
