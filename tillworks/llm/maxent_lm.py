"""A hashed maximum-entropy language model with a class-factored softmax.

The 61,440 most frequent words are units of their own; all others share 4,096 units by their
hash. The number of a unit is four digits of 16 values: class, class within the class, and so
on. A token's probability is that of each digit given the digits before it and what went
before in the text, times, for shared units, the word's smoothed share of the unit:

    P(word | before) = P(d0 | before) P(d1 | d0, before) ... P(d3 | d0 d1 d2, before) P(word | unit)

Each digit is a softmax over its plain log share plus features of the tokens before: the last
one, the second and third last (skips) and the last two as a pair, each joined with the digits
before and hashed to a row of 16 weights. P(word | unit) is (c + 0.1) / (N + 0.1 (V + 1)) with
c, N and V counted within the unit, so unknown words have a share too and the factors sum to one.

Training is by full gradient updates, whose sums over the texts are made by Spark and do not
depend on how texts are dealt to tasks. The first starts from plain shares: a row's observed
less expected counts (expected: its tokens times the shares) give its direction, taken as
logarithm of the quotient, as in iterative scaling. The next ones move the 16 strengths with
which the families of features (by digit and kind) count: sums of gradient and curvature over
all texts give a Newton step. Texts are dealt into halves by their hash; a half's strengths are
trained with rows counted on the other, so that a text does not vouch for itself. The final
rows are counted on all training texts. Strengths keep the sign of the evidence.

Every text is split once, into unit numbers that are written and read by all later steps.
The rows of weights and the most frequent words have a fixed size, so their broadcast is
bounded; counts behind them grow with the corpus, and rare words are scored by a join with the
table of counts. Words are known by a 64-bit hash.

A null text counts as empty and consists of the end token; a null id counts as empty text
in the split. Repeated rows are scored each. With no training text all words are unknown and
share the small plain share of their unit. An empty table gives an empty table; other columns
are ignored.
"""

import functools
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.llm.common import crc32_remainder, small_batches, text_bytes
from tillworks.session import cut_lineage

DIGITS, WAYS = 4, 16
UNITS = WAYS**DIGITS
SHARED_UNITS = 1 << 12
HEAD_WORDS = UNITS - SHARED_UNITS
BEFORE_TEXT = UNITS + SHARED_UNITS - 1  # as a context: no token
SMOOTHING = 0.1
ROW_SMOOTHING = 4.0
BATCH = 4096
# rows of each feature (last token, second, third, last two) per node of each digit
FAMILY_ROWS = np.array([[4096, 4096, 4096, 16384], [2048, 512, 512, 2048], [128, 32, 32, 128],
                        [8, 2, 2, 8]])
FAMILIES = FAMILY_ROWS.shape[1]
NODES = WAYS ** np.arange(DIGITS)
_SIZES = FAMILY_ROWS * NODES[:, None]
_FIRST_ROW = (np.cumsum(_SIZES) - _SIZES.ravel()).reshape(_SIZES.shape)
WEIGHT_ROWS = int(_SIZES.sum())
_FIRST_NODE = np.cumsum(NODES) - NODES
BLOCK_ROWS = 512  # rows of counts that are shuffled as one
_BLOCKS = -(-WEIGHT_ROWS // BLOCK_ROWS)
FIRST_STRENGTH = 0.5
_MOST = np.float32(80)  # larger logits count as this, whose exponential is finite
_CACHE_WORDS = 300_000
_COUNTED_WORDS = 200_000
# no word contains a space
END = np.int64(np.uint64(xxhash.xxh64_intdigest(b" ")).view(np.int64))


def word_hash(word: bytes) -> int:
    value = xxhash.xxh64_intdigest(word)
    return value - (1 << 64) if value >> 63 else value


def shared_unit(value: int) -> int:
    """The unit of a word outside the head, from its hash."""
    return HEAD_WORDS + value % SHARED_UNITS


def count_words(training: DataFrame) -> DataFrame:
    """word (hash), c: every word of the texts, and the end."""
    def run(batches):
        counts, texts = Counter(), 0

        def rows():
            return pa.record_batch([pa.array(map(word_hash, counts), pa.int64()),
                                    pa.array(counts.values(), pa.int64())], ["word", "c"])

        for batch in batches:
            for text in text_bytes(batch.column(0)):
                counts.update((text or b"").lower().split())
                texts += 1
                if len(counts) > _COUNTED_WORDS:
                    yield rows()
                    counts.clear()
        yield rows()
        if texts:
            yield pa.record_batch([pa.array([int(END)]), pa.array([texts], pa.int64())],
                                  ["word", "c"])

    return training.select("text").mapInArrow(run, "word bigint, c bigint").groupBy("word").agg(
        F.sum("c").alias("c"))


class Vocabulary:
    """The most frequent words and what is known of the rest by unit; of bounded size."""

    def __init__(self, head, tokens, distinct, shared):
        """``head``: (word, c), most frequent first; ``shared``: unit -> (N, V) of others."""
        self.tokens, self.distinct = tokens, distinct
        self.rank = {w: i for i, (w, _) in enumerate(head)}
        mass = np.full(UNITS, 1e-3)  # a unit without a word never occurs
        mass[:len(head)] = np.array([c for _, c in head], float) + SMOOTHING
        mass[HEAD_WORDS:] = SMOOTHING
        for unit, (n, v) in shared.items():
            mass[unit] = n + SMOOTHING * (v + 1)
        self.mass = mass  # of a shared unit: what a count is divided by within it
        self.log_mass = np.log10(mass)
        self.base_below = np.log10(tokens + SMOOTHING * (distinct + 1))

    def log_shares(self):
        """ln of the share of each way among those of its node, a row of WAYS per node."""
        out, mass = [], self.mass
        for digit in reversed(range(DIGITS)):
            ways = mass.reshape(WAYS, NODES[digit]).T
            mass = ways.sum(axis=1)
            out.append(np.log(ways / mass[:, None]))
        return np.concatenate(out[::-1])


def learn_vocabulary(counts: DataFrame) -> Vocabulary:
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    head = [(r["word"], r["c"]) for r in counts.select("word", "c").orderBy(
        F.desc("c"), "word").limit(HEAD_WORDS).collect()]
    shared = {}
    if len(head) == HEAD_WORDS:
        word, c = head[-1]
        behind = (F.col("c") < c) | ((F.col("c") == c) & (F.col("word") > word))
        unit = (F.pmod("word", F.lit(SHARED_UNITS)) + HEAD_WORDS).alias("unit")
        shared = {r["unit"]: (r["n"], r["v"]) for r in counts.where(behind).groupBy(unit).agg(
            F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    return Vocabulary(head, total["n"] or 0, total["v"], shared)


class Coder(dict):
    """What stands for a word, with a bounded cache: its rank in the head, else its hash.

    A hash that equals a rank is as rare as two equal hashes.
    """

    def __init__(self, vocabulary):
        self._rank = vocabulary.rank

    def __missing__(self, word):
        value = word_hash(word)
        self[word] = value = self._rank.get(value, value)
        return value

    def code(self, texts):
        """(tokens of each text, value and unit of every token, in order)."""
        if len(self) > _CACHE_WORDS:
            self.clear()
        values, sizes, find = [], [], self.__getitem__
        for text in texts:
            words = (text or b"").lower().split()
            words.append(b" ")
            values += map(find, words)
            sizes.append(len(words))
        values = np.array(values, np.int64)
        in_head = (values >= 0) & (values < HEAD_WORDS)
        return np.array(sizes, np.int64), values, np.where(in_head, values, shared_unit(values))


def code_texts(documents: DataFrame, vocabulary) -> DataFrame:
    """Each row's units (16 bits each) and what its words need beside the model.

    row, doc_id, held_out, half, n_tokens, known and base (of words in the head), within (log10
    of shares within units, but for the counts of words outside the head), words and times
    (distinct words outside the head), units.
    """
    known = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        own, coder = known.value, Coder(known.value)
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            sizes, word, unit = coder.code(text_bytes(batch.column(3)))
            text = np.repeat(np.arange(rows), sizes)
            in_head = unit < HEAD_WORDS
            total = functools.partial(np.bincount, text, minlength=rows)
            rest = np.flatnonzero(~in_head)
            order = np.lexsort((word[rest], text[rest]))
            rest_text, rest_word = text[rest][order], word[rest][order]
            new = np.flatnonzero(np.append(True, (rest_text[1:] != rest_text[:-1])
                                           | (rest_word[1:] != rest_word[:-1]))
                                 ) if len(rest) else np.empty(0, np.int64)
            times = np.diff(np.append(new, len(rest))).astype(np.int32)
            ends = np.cumsum(np.bincount(rest_text[new], minlength=rows))
            offsets = pa.array(np.append(0, ends).astype(np.int32))
            mass = own.log_mass[unit]
            codes = unit.astype(np.uint16).tobytes()
            at = 2 * np.append(0, np.cumsum(sizes))
            yield pa.record_batch(
                [pa.array(number + np.arange(rows)), *batch.columns[:3], pa.array(sizes),
                 total(weights=in_head).astype(np.int64),
                 total(weights=np.where(in_head, mass, 0.0)) - sizes * own.base_below,
                 total(weights=np.where(in_head, 0.0, -mass)),
                 pa.ListArray.from_arrays(offsets, pa.array(rest_word[new])),
                 pa.ListArray.from_arrays(offsets, pa.array(times)),
                 pa.array([codes[i:j] for i, j in zip(at[:-1], at[1:])], pa.binary())],
                ["row", "doc_id", "held_out", "half", "n_tokens", "known", "base", "within",
                 "words", "times", "units"])
            number += rows

    half = F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half")
    return cut_lineage(documents.select("doc_id", "held_out", half, "text").mapInArrow(
        run, "row bigint, doc_id bigint, held_out boolean, half int, n_tokens bigint, "
             "known bigint, base double, within double, words array<bigint>, times array<int>, "
             "units binary"))


def decode(column):
    """(tokens of each text, unit of every token) of a column of units."""
    texts = column.to_pylist()
    units = np.frombuffer(b"".join(texts), np.uint16).astype(np.int64)
    return np.array([len(t) // 2 for t in texts], np.int64), units


def contexts(sizes, unit):
    """What stands before each token of its text: last, second and third unit, last two."""
    text = np.repeat(np.arange(len(sizes)), sizes)
    before = []
    for back in (1, 2, 3):
        x = np.full(len(unit), BEFORE_TEXT, np.int64)
        x[back:] = np.where(text[back:] == text[:-back], unit[:-back], BEFORE_TEXT)
        before.append(x)
    pair = ((before[0] << 17) + before[1]) * 2654435761 >> 20
    return [*before, pair]


def feature_rows(digit, before, node):
    """The row of weights of each feature of a digit; a row belongs to one node."""
    return [_FIRST_ROW[digit, f] + node * FAMILY_ROWS[digit, f]
            + (x & (FAMILY_ROWS[digit, f] - 1)) for f, x in enumerate(before)]


def node_and_way(digit, unit):
    return unit & (NODES[digit] - 1), unit >> 4 * digit & (WAYS - 1)


def count_rows(coded: DataFrame):
    """Counts of the ways after each row, for each half: array of (2, WEIGHT_ROWS, WAYS)."""
    cells = _BLOCKS * BLOCK_ROWS * WAYS

    def count(batches):
        counts, one = np.zeros((2, cells), np.int32), np.int32(1)  # of one type: far faster
        for batch in batches:
            sizes, unit = decode(batch.column(1))
            if not len(unit):
                continue
            half = np.repeat(batch.column(0).to_numpy(), sizes)
            before = contexts(sizes, unit)
            for own, target in enumerate(counts):
                mine = half == own
                some, ahead = unit[mine], [x[mine] for x in before]
                for digit in range(DIGITS):
                    node, way = node_and_way(digit, some)
                    for rows in feature_rows(digit, ahead, node):
                        np.add.at(target, rows * WAYS + way, one)
        blocks = counts.reshape(2 * _BLOCKS, -1)
        for block in np.flatnonzero(blocks.any(axis=1)):
            yield pa.record_batch([pa.array([block], pa.int32()),
                                   pa.array([blocks[block].tobytes()], pa.binary())],
                                  ["block", "counts"])

    def add(batches):
        sums = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = np.frombuffer(counts, np.int32)
                sums[block] = sums[block] + counts if block in sums else counts.astype(np.int64)
        for block, total in sums.items():
            yield pa.record_batch([pa.array([block], pa.int32()),
                                   pa.array([total.astype(np.float32).tobytes()], pa.binary())],
                                  ["block", "counts"])

    schema = "block int, counts binary"
    # a task adds up what it reads as it comes, so it holds its blocks once
    found = coded.select("half", "units").mapInArrow(count, schema).repartition(
        "block").mapInArrow(add, schema).toArrow()
    out = np.zeros((2 * _BLOCKS, BLOCK_ROWS * WAYS), np.float32)
    for block, counts in zip(found["block"].to_pylist(), found["counts"]):
        out[block] = np.frombuffer(counts.as_buffer(), np.float32)
    return out.reshape(2, -1, WAYS)[:, :WEIGHT_ROWS]


def first_update(counts, log_shares) -> np.ndarray:
    """ln of the smoothed quotient of observed and expected counts, by row and way."""
    weights = np.empty_like(counts)
    for digit in range(DIGITS):
        shares = np.exp(log_shares[_FIRST_NODE[digit]:][:NODES[digit]])
        for f in range(FAMILIES):
            rows = slice(_FIRST_ROW[digit, f], _FIRST_ROW[digit, f] + _SIZES[digit, f])
            seen = counts[rows].reshape(NODES[digit], -1, WAYS)
            prior = ROW_SMOOTHING * shares[:, None]
            expected = seen.sum(axis=2, keepdims=True) * shares[:, None]
            weights[rows] = np.log((seen + prior) / (expected + prior)).reshape(-1, WAYS)
    return weights


class Model:
    def __init__(self, log_shares, weights, strengths):
        self.log_shares = log_shares.astype(np.float32)
        self.weights = weights
        self.strengths = strengths.astype(np.float32)
        self._ones = np.ones(WAYS, np.float32)

    @functools.cached_property
    def _folded(self):
        """Weights times strengths; a digit's first family holds the log shares as well."""
        out = self.weights.copy()
        for digit in range(DIGITS):
            shares = self.log_shares[_FIRST_NODE[digit]:][:NODES[digit]]
            for f, strength in enumerate(self.strengths[digit]):
                out[_FIRST_ROW[digit, f]:][:_SIZES[digit, f]] *= strength
            rows = out[_FIRST_ROW[digit, 0]:][:_SIZES[digit, 0]]
            rows += np.repeat(shares, FAMILY_ROWS[digit, 0], axis=0)
        return out

    def log10(self, before, unit):
        """log10 of the chance of every token's unit."""
        out = np.empty(len(unit))
        weights = self._folded
        for i in range(0, len(unit), BATCH):
            part = slice(i, i + BATCH)
            ahead, own = [x[part] for x in before], unit[part]
            tokens, total = np.arange(len(own)), 0
            for digit in range(DIGITS):
                node, way = node_and_way(digit, own)
                rows = feature_rows(digit, ahead, node)
                x = weights.take(rows[0], axis=0, mode="clip")
                for f in range(1, FAMILIES):
                    if self.strengths[digit, f]:
                        x += weights.take(rows[f], axis=0, mode="clip")
                np.minimum(x, _MOST, out=x)
                taken = x[tokens, way]
                total = total + taken - np.log(np.exp(x, out=x) @ self._ones)
            out[part] = total
        return out / np.log(10)

    def slopes(self, before, unit):
        """Gradient of ln P by the strengths and its negated curvature, by digit."""
        out = np.zeros((DIGITS, FAMILIES, FAMILIES + 1))
        held = np.empty((2, FAMILIES, BATCH, WAYS), np.float32)
        for i in range(0, len(unit), BATCH):
            part = slice(i, i + BATCH)
            ahead, own = [x[part] for x in before], unit[part]
            tokens = np.arange(len(own))
            taken, spread = held[:, :, :len(own)] if len(own) == BATCH else np.empty(
                (2, FAMILIES, len(own), WAYS), np.float32)
            flat, spread_flat = (x.reshape(FAMILIES, -1) for x in (taken, spread))
            for digit in range(DIGITS):
                node, way = node_and_way(digit, own)
                for rows, place in zip(feature_rows(digit, ahead, node), taken):
                    self.weights.take(rows, axis=0, out=place, mode="clip")
                x = (self.strengths[digit] @ flat).reshape(-1, WAYS)
                x += self.log_shares.take(_FIRST_NODE[digit] + node, axis=0, mode="clip")
                np.minimum(x, _MOST, out=x)
                np.exp(x, out=x)
                x /= (x @ self._ones)[:, None]
                np.multiply(taken, x, out=spread)
                mean = (spread.reshape(-1, WAYS) @ self._ones).reshape(FAMILIES, -1)
                out[digit, :, 1:] += np.array([[np.dot(a, b) for a in flat]
                                               for b in spread_flat]) - mean @ mean.T
                x[tokens, way] -= 1
                out[digit, :, 0] -= flat @ x.ravel()
        return out


def train(coded: DataFrame, log_shares):
    """Weights and strengths from the coded training texts; see the top of this module."""
    context = coded.sparkSession.sparkContext
    counts = count_rows(coded)
    strengths = np.full((DIGITS, FAMILIES), FIRST_STRENGTH)
    for half in (0, 1):
        shared = context.broadcast((log_shares, first_update(counts[1 - half], log_shares),
                                    strengths))

        def run(batches, shared=shared):
            model, total = Model(*shared.value), 0
            for batch in batches:
                sizes, unit = decode(batch.column(0))
                total = total + model.slopes(contexts(sizes, unit), unit)
            if not np.isscalar(total):
                flat = total.ravel()
                yield pa.record_batch([pa.array(np.arange(len(flat), dtype=np.int32)),
                                       pa.array(flat)], ["place", "value"])

        sums = np.zeros(DIGITS * FAMILIES * (FAMILIES + 1))
        for r in coded.where(F.col("half") == half).select("units").mapInArrow(
                run, "place int, value double").groupBy("place").agg(
                F.sum("value").alias("value")).collect():
            sums[r["place"]] = r["value"]
        sums = sums.reshape(DIGITS, FAMILIES, FAMILIES + 1)
        curve = sums[:, :, 1:] + np.eye(FAMILIES)  # one token's worth of doubt
        step = np.linalg.solve(curve, sums[:, :, :1])[:, :, 0]
        strengths = np.clip(strengths + step, 0.0, 2.0)
    return first_update(counts.sum(axis=0), log_shares), strengths


def score(coded: DataFrame, vocabulary, counts: DataFrame, model) -> DataFrame:
    """All rows of doc_id, held_out: with n_tokens, n_known, base_score and score."""
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            sizes, unit = decode(batch.column(batch.num_columns - 1))
            text = np.repeat(np.arange(len(sizes)), sizes)
            total = np.bincount(text, own.log10(contexts(sizes, unit), unit), len(sizes))
            yield pa.record_batch([*batch.columns[:-1], pa.array(total)],
                                  [*batch.schema.names[:-1], "model"])

    kept = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "within"]
    scored = coded.select(*kept, "units").mapInArrow(
        run, "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, "
             "base double, within double, model double")
    rare = coded.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select(
        "row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    # rare words share a unit: the count's logarithm enters both scores alike
    found = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTHING)).alias("rest"),
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rest_known"))
    rest = F.coalesce("rest", F.lit(0.0))
    return scored.join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("rest_known", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(vocabulary.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + rest).alias("base_score"),
        (F.col("model") + F.col("within") + rest).alias("score"))


def fit_and_score(documents: DataFrame, id_col="doc_id", text_col="text", folds=10) -> DataFrame:
    """Learn from the rows that are not held out, and score all rows."""
    small_batches(documents.sparkSession)
    rows = documents.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        (crc32_remainder(F.col(id_col), folds) == 0).alias("held_out"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counts = cut_lineage(count_words(rows.where("not held_out")))
    vocabulary = learn_vocabulary(counts)
    coded = code_texts(rows, vocabulary)
    log_shares = vocabulary.log_shares()
    model = (log_shares, *train(coded.where("not held_out"), log_shares))
    return score(coded, vocabulary, counts, model)
