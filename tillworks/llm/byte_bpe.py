"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts of a batch are laid out as one array of code points with a separator between
them. Each code point's class names a transition function of a three-state automaton
(ordinary, after a space, within a run of other signs); the functions are closed under
composition, so their running composition is an associative scan over small table
look-ups, and no regular expression runs. Its states say where an apostrophe starts a
contraction; the other boundaries follow from neighbouring classes. The slices between
boundaries go to cached pair merging (`bpe.PairMerges`). Byte offsets of slices and
tokens are kept, so that ids decode to the bytes they stand for.

The pattern this equals is that of byte-level vocabularies: the contractions
's 't 're 've 'm 'll 'd, letters, numbers and other signs each with one leading space,
and runs of white space.

Every row is encoded on its own: a null text counts as empty and gives no ids, repeated
rows and ids give repeated results, an empty table gives an empty table, texts of any
length are encoded whole, and other columns are ignored.
"""

import base64
import functools
import hashlib
import sys
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.llm.bpe import PairMerges
from tillworks.llm.common import small_batches, text_groups

LETTER, NUMBER, OTHER, SPACE, WHITE, BREAK = range(6)
# fixed values: the code points with the White_Space property
_WHITE_SPACE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
                0x202F, 0x205F, 0x3000]
_SEPARATOR = sys.maxunicode + 1
_GROUP_BYTES = 1 << 20
_CACHE_WORDS = 300_000

# transition functions: the identity, constant 0, 1, 2, and "contraction", which stays in
# state 0 from state 0 and goes to state 2 from the others
_IDENTITY, _TO_0, _TO_1, _TO_2, _CONTRACTION = range(5)
_FUNCTIONS = np.array([[0, 1, 2], [0, 0, 0], [1, 1, 1], [2, 2, 2], [0, 2, 2]], np.uint8)


def _compositions():
    table = np.zeros((5, 5), np.uint8)
    for f in range(5):
        for g in range(5):
            both = _FUNCTIONS[g][_FUNCTIONS[f]]
            table[f, g] = next(k for k in range(5) if (_FUNCTIONS[k] == both).all())
    return table


_THEN = _compositions()
_CLASS_FUNCTION = np.array([_TO_0, _TO_0, _TO_2, _TO_1, _TO_0, _TO_0], np.uint8)


@functools.lru_cache(maxsize=1)
def _class_table():
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER)
                         for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[_WHITE_SPACE] = WHITE
    table[0x20] = SPACE
    return np.append(table, np.uint8(BREAK))


def compose_scan(functions, block=64):
    """Running composition: out[i] is the function of elements 0..i, applied in order.

    Blocks are scanned side by side, then their totals by the same method.
    """
    n = len(functions)
    if n <= block:
        out = functions.copy()
        for i in range(1, n):
            out[i] = _THEN[out[i - 1], out[i]]
        return out
    rows = -(-n // block)
    padded = np.full(rows * block, _IDENTITY, np.uint8)
    padded[:n] = functions
    grid = np.ascontiguousarray(padded.reshape(rows, block).T)
    for i in range(1, block):
        grid[i] = _THEN[grid[i - 1], grid[i]]
    before = np.empty(rows, np.uint8)
    before[0], before[1:] = _IDENTITY, compose_scan(grid[-1], block)[:-1]
    return _THEN[before, grid].T.reshape(-1)[:n]


def _contractions(points):
    """Length of the contraction that could begin at each code point, else 0."""
    n = len(points)
    size = np.zeros(n, np.int8)
    at = np.flatnonzero(points == 0x27)
    if not len(at):
        return size
    ahead = np.append(points, [_SEPARATOR, _SEPARATOR])
    one, two = ahead[at + 1], ahead[at + 2]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = np.zeros(len(at), bool)
    for a, b in ("re", "ve", "ll"):
        long |= (one == ord(a)) & (two == ord(b))
    size[at] = np.where(short, 2, np.where(long, 3, 0))
    return size


def boundaries(points):
    """Starts of the pattern's matches in code points separated by ``_SEPARATOR``."""
    n = len(points)
    kind = _class_table()[points]
    size = _contractions(points)
    function = _CLASS_FUNCTION[kind]
    function[size > 0] = _CONTRACTION
    state = np.zeros(n, np.uint8)
    state[1:] = _FUNCTIONS[compose_scan(function)[:-1], 0]
    kind_before = np.empty_like(kind)
    kind_before[0], kind_before[1:] = BREAK, kind[:-1]
    kind_after = np.empty_like(kind)
    kind_after[-1], kind_after[:-1] = BREAK, kind[1:]
    white = (kind == SPACE) | (kind == WHITE)
    white_before = (kind_before == SPACE) | (kind_before == WHITE)
    ends_run = white & (kind_after != SPACE) & (kind_after != WHITE) & (kind_after != BREAK)
    start = np.where(white, ~white_before | ends_run,
                     (kind != kind_before) & (kind_before != SPACE))
    found = np.flatnonzero((size > 0) & (state == 0))
    start[found] = True
    start[found + 1] = False
    after = found + size[found]
    inside = after < n
    start[after[inside & (kind[np.minimum(after, n - 1)] == LETTER)]] = True
    return start & (kind != BREAK)


def cut(texts):
    """Slices of each text (str), as bytes, and the number of slices of each text.

    Also returns the byte offset of each slice in its text.
    """
    joined = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    points = np.insert(joined, ends, _SEPARATOR)
    starts = np.flatnonzero(boundaries(points))
    width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF).astype(np.int64)
    width[ends + np.arange(len(texts))] = 0
    byte_at = np.cumsum(width) - width
    total = int(width.sum())
    raw = "".join(texts).encode()
    first = byte_at[starts]
    last = np.append(first[1:], total)
    owner = np.searchsorted(ends + np.arange(len(texts)), starts)
    text_start = byte_at[np.append(0, ends[:-1] + np.arange(1, len(texts)))] if texts else first
    slices = [raw[a:b] for a, b in zip(first.tolist(), last.tolist())]
    return slices, np.bincount(owner, minlength=len(texts)), first - text_start[owner]


class Vocabulary:
    """Ranks of byte strings with a bounded cache of whole slices."""

    def __init__(self, path):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self._byte = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items()
                 for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        left, right, rank = np.array(pairs, np.int64).T
        self._merges = PairMerges(left, right, rank, rank)
        # one object for each id and its text, shared by all cached slices
        top = max(self.tokens) + 1
        self._numbers, self._names = list(range(top)), list(map(str, range(top)))
        self._cache = {}

    def encode_slices(self, slices):
        """For every slice a pair: its ids, and their decimal text."""
        found = list(map(self._cache.get, slices))
        if None not in found:
            return found
        new = {s for s, known in zip(slices, found) if known is None}
        if len(self._cache) + len(new) > _CACHE_WORDS:
            self._cache.clear()
            new = set(slices)
        cache, rest = self._cache, []
        for s in new:
            rank = self.ranks.get(s)
            if rank is None:
                rest.append(s)
            else:
                cache[s] = ((rank,), str(rank))
        if rest:
            symbols = self._byte[np.frombuffer(b"".join(rest), np.uint8)]
            ids, counts = self._merges.merge(symbols, [len(s) for s in rest])
            numbers, names = self._numbers, self._names
            ids, begin = ids.tolist(), 0
            for s, end in zip(rest, np.cumsum(counts).tolist()):
                own = [numbers[i] for i in ids[begin:end]]
                cache[s] = (tuple(own), ",".join([names[i] for i in own]))
                begin = end
        return list(map(cache.__getitem__, slices))

    def encode_words(self, texts):
        """For each text (str): the coded slices it consists of, in order."""
        for first, last in text_groups(texts, _GROUP_BYTES):
            group = texts[first:last]
            if not any(group):
                yield from ([] for _ in group)
                continue
            slices, counts, _ = cut(group)
            coded = self.encode_slices(slices)
            begin = 0
            for end in np.cumsum(counts).tolist():
                yield coded[begin:end]
                begin = end

    def encode(self, texts):
        """For each text (str): the list of its ids."""
        return [list(chain.from_iterable([ids for ids, _ in words]))
                for words in self.encode_words(texts)]

    def offsets(self, ids):
        """Byte offset of each token of an id list."""
        size = np.array([len(self.tokens[i]) for i in ids], np.int64)
        return np.cumsum(size) - size

    def decode(self, ids):
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def vocabulary(path):
    """One vocabulary per worker process; it is small and the file is installed everywhere."""
    return Vocabulary(path)


def encode(documents: DataFrame, path: str, id_col="doc_id", text_col="text") -> DataFrame:
    """Ids and the byte offset of each token: doc_id, ids array<int>, offsets array<bigint>."""
    small_batches(documents.sparkSession)

    def run(batches):
        own = vocabulary(path)
        for batch in batches:
            coded = own.encode([t or "" for t in batch.column(1).to_pylist()])
            yield pa.record_batch([
                batch.column(0), pa.array(coded, pa.list_(pa.int32())),
                pa.array([own.offsets(ids) for ids in coded], pa.list_(pa.int64()))],
                ["doc_id", "ids", "offsets"])

    chosen = documents.select(F.col(id_col).cast("bigint").alias("doc_id"),
                              F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id bigint, ids array<int>, offsets array<bigint>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The bytes that ids stand for: doc_id, decoded binary. Null ids count as none."""
    small_batches(encoded.sparkSession)

    def run(batches):
        own = vocabulary(path)
        for batch in batches:
            yield pa.record_batch([
                batch.column(0),
                pa.array([own.decode(ids or []) for ids in batch.column(1).to_pylist()],
                         pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, decoded binary")


def round_trip(documents: DataFrame, path: str, id_col="doc_id", text_col="text") -> DataFrame:
    """Encode and decode in one pass and return digests of both.

    Columns: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas),
    decoded_sha256 (of the decoded bytes).
    """
    small_batches(documents.sparkSession)

    def run(batches):
        own = vocabulary(path)
        for batch in batches:
            counts, ids_sha, decoded_sha = [], [], []
            for words in own.encode_words([t or "" for t in batch.column(1).to_pylist()]):
                ids = list(chain.from_iterable([ids for ids, _ in words]))
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(
                    ",".join([name for _, name in words]).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()),
                                   pa.array(ids_sha), pa.array(decoded_sha)],
                                  ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    chosen = documents.select(F.col(id_col).cast("bigint").alias("doc_id"),
                              F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, "
                                  "decoded_sha256 string")
