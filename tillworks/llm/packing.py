"""Cost-balanced packing of token ids into training sequences.

A piece of n tokens costs ``LINEAR * n + QUADRATIC * n * n``: attention stays within
a document. Documents go, dearest first, to the sequence of lowest cost that still has
room for them; where none has, a document is cut and fills the cheapest open sequence.
Documents of a sequence length or more first give whole sequences of their own.

Each task packs the documents it has tokenised, in groups of a bounded number of
tokens, so nothing is shuffled and memory does not grow with the table. A group closes
with full sequences only and hands its odd tokens to the next one; the last group of a
task ends in sequences whose lengths are the powers of two that add up to its odd
tokens. No sequence needs padding then.

Strings of the vocabulary's added tokens, as <|endoftext|>, are ordinary text or, with
``added_tokens``, become their ids as in the library's plain call; the queries do the latter.

Every row is packed on its own: a null or empty text consists of the end id alone,
repeated rows are packed repeatedly, an empty table gives an empty table, other columns
are ignored. Sequence ids hold the partition in their upper bits; a repeated task gives
the same rows again.
"""

import functools
import json
import re
import string

import numpy as np
import pyarrow as pa
import regex

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.llm.bpe import PairMerges
from tillworks.llm.common import small_batches, text_bytes, text_groups

SEQUENCE_TOKENS = 4096
GROUP_SEQUENCES = 256
END_ID = 2
# attention's share overtakes the linear share at 2,048 tokens
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
# words of one generation of the cache; two are held
_CACHE_WORDS = 250_000
_GROUP_BYTES = 1 << 21
# fixed value: how the vocabulary splits lower-cased text
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# signs that composition leaves alone and that lower-case one by one
_PLAIN = re.compile("[!-~À-įı-ɏ]+")
# signs that are one piece of their own behind letters
_SIGNS = string.punctuation
_SIGN_BYTES = _SIGNS.encode()


class WordVocabulary:
    """Ids of white-space separated words, equal to the library's, from cached pair merging.

    No merge, contraction or composition crosses white space, so words are coded one by
    one. Words with signs outside ASCII and Latin letters go to the library itself.
    """

    def __init__(self, path):
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.encode_special_tokens = True  # their strings are ordinary text
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        model = stored["model"]
        # found in the text as it is, before it is lower-cased
        self._added = {t["content"].encode(): np.array([t["id"]], "<u4").tobytes()
                       for t in stored["added_tokens"]}
        self._added_strings = re.compile(b"(" + b"|".join(map(re.escape, self._added)) + b")")
        ids, suffix = model["vocab"], model["end_of_word_suffix"]
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        sign = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self._byte = np.array([ids[sign[b]] for b in range(256)], np.int32)
        self._last = np.array([ids[sign[b] + suffix] for b in range(256)], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self._merges = PairMerges([ids[a] for a, _ in pairs], [ids[b] for _, b in pairs],
                                  range(len(pairs)), [ids[a + b] for a, b in pairs])
        self._cache, self._older = {}, {}

    def plain_ids(self, texts):
        """As ``ids``, but strings of added tokens become those tokens and part the text."""
        marked = [any(t in text for t in self._added) for text in texts]
        if not any(marked):
            return self.ids(texts)
        parts = [self._added_strings.split(text) if own else [text]
                 for text, own in zip(texts, marked)]
        coded = iter(self.ids([p for own in parts for p in own[::2]]))
        return [b"".join(self._added[p] if i % 2 else next(coded) for i, p in enumerate(own))
                for own in parts]

    def ids(self, texts):
        """Ids of each text (UTF-8 bytes) as little-endian unsigned 32-bit numbers."""
        out = []
        for first, last in text_groups(texts, _GROUP_BYTES):
            # as bytes: lowers A-Z, splits at ASCII white space
            words = [text.lower().split() for text in texts[first:last]]
            new = set().union(*words).difference(self._cache)
            if len(self._cache) + len(new) > _CACHE_WORDS:
                self._older, self._cache = self._cache, {}
                new = set().union(*words)
            known = [w for w in new if w in self._older]
            self._cache.update(zip(known, map(self._older.__getitem__, known)))
            self._learn(new.difference(known))
            out += [b"".join(map(self._cache.__getitem__, own)) for own in words]
        return out

    def forget(self):
        self._cache, self._older = {}, {}

    def _learn(self, words):
        split, strange = {}, []
        for word in words:  # as bytes: only A-Z and a-z count as letters
            if word.isalpha():
                continue
            start = word.rstrip(_SIGN_BYTES)
            if start.isalpha():
                split[word] = (start, word[len(start):])
            elif _PLAIN.fullmatch(text := word.decode()):
                text = text.lower()
                start = text.rstrip(_SIGNS)
                own = ([start, text[len(start):]] if start.isalpha() else _PIECES.findall(text))
                split[word] = [p.encode() for p in own if p]
            else:
                strange.append((word, text))
        # a piece is coded like a word of its own
        pieces = list(set(filter(bytes.isalpha, words)).union(*split.values()).difference(
            self._cache))
        if pieces:
            raw = np.frombuffer(b"".join(pieces), np.uint8)
            lengths = np.array(list(map(len, pieces)))
            symbols, last = self._byte[raw], np.cumsum(lengths) - 1
            symbols[last] = self._last[raw[last]]
            ids, counts = self._merges.merge(symbols, lengths)
            ids, end = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
            self._cache.update((p, ids[a:b]) for p, a, b in zip(pieces, [0, *end], end))
        for word, own in split.items():
            self._cache[word] = b"".join([self._cache[p] for p in own])
        if strange:
            for (word, _), code in zip(strange, self._library.encode_batch(
                    [text for _, text in strange], add_special_tokens=False)):
                self._cache[word] = np.array(code.ids, "<u4").tobytes()


@functools.lru_cache(maxsize=2)
def word_vocabulary(path):
    return WordVocabulary(path)


def cost(tokens):
    return LINEAR * tokens + QUADRATIC * tokens * tokens


def assign(lengths, capacities):
    """Place documents of given lengths, in pieces, into sequences of given capacities.

    The capacities must add up to the lengths, and no length may exceed the largest. Gives
    (document, start, length, sequence, offset) arrays; every sequence is filled.
    """
    left = np.asarray(capacities, np.int64).copy()
    filled = np.zeros(len(left), np.int64)
    load = np.zeros(len(left))
    out = []
    for document in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        start, rest = 0, int(lengths[document])
        while rest:
            roomy = left >= rest
            if not roomy.any():
                roomy = left > 0
            sequence = int(np.where(roomy, load, np.inf).argmin())
            length = min(rest, int(left[sequence]))
            out.append((document, start, length, sequence, int(filled[sequence])))
            filled[sequence] += length
            left[sequence] -= length
            load[sequence] += cost(length)
            start, rest = start + length, rest - length
    return np.array(out, np.int64).reshape(-1, 5).T


class _Packer:
    """Collects documents and gives rows of pieces, group by group."""

    def __init__(self, partition, size, sequences):
        self._next = partition << 33
        self._size, self._sequences = size, sequences
        self._waiting, self._tokens = [], 0  # (doc_id, ids, start, doc_tokens)

    def add(self, doc_id, ids):
        """Rows of the whole sequences a document fills alone; its rest waits."""
        tokens, width, rows = len(ids) // 4, 4 * self._size, []
        for start in range(0, tokens - self._size + 1, self._size):
            rows.append((doc_id, start, ids[4 * start:4 * start + width], tokens, self._next, 0))
            self._next += 1
        done = tokens // self._size * self._size
        if tokens > done:
            self._waiting.append((doc_id, ids[4 * done:], done, tokens))
            self._tokens += tokens - done
        return rows

    def full(self):
        return self._tokens >= self._size * self._sequences

    def close(self, last):
        """Pack what waits: full sequences, and at the end also the powers of two below."""
        odd = self._tokens % self._size
        capacities = [self._size] * (self._tokens // self._size)
        kept = []
        if last:
            capacities += [1 << b for b in reversed(range(odd.bit_length())) if odd >> b & 1]
        else:
            while odd:  # the odd tokens are cut from the documents that came last
                doc_id, ids, start, tokens = self._waiting.pop()
                cut = max(0, len(ids) // 4 - odd)
                kept.append((doc_id, ids[4 * cut:], start + cut, tokens))
                odd -= len(ids) // 4 - cut
                if cut:
                    self._waiting.append((doc_id, ids[:4 * cut], start, tokens))
        rows = []
        documents, starts, lengths, sequences, offsets = assign(
            [len(x[1]) // 4 for x in self._waiting], capacities)
        for d, s, n, q, o in zip(*(x.tolist() for x in (documents, starts, lengths, sequences,
                                                        offsets))):
            doc_id, ids, start, tokens = self._waiting[d]
            rows.append((doc_id, start + s, ids[4 * s:4 * (s + n)], tokens, self._next + q, o))
        self._next += len(capacities)
        self._waiting, self._tokens = kept[::-1], sum(len(x[1]) // 4 for x in kept)
        return rows


def pack(documents: DataFrame, path: str, id_col="doc_id", text_col="text",
         sequence_tokens=SEQUENCE_TOKENS, group_sequences=GROUP_SEQUENCES,
         added_tokens=False) -> DataFrame:
    """One row per piece of a document.

    doc_id, start (ids of the document before the piece), token_ids (binary, little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset (place in the sequence).
    """
    small_batches(documents.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("token_ids", pa.binary()),
                        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
                        ("offset", pa.int64())])
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        words = word_vocabulary(path)
        code = words.plain_ids if added_tokens else words.ids
        packer = _Packer(TaskContext.get().partitionId(), sequence_tokens, group_sequences)

        def batch_of(rows):
            return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)],
                                   schema=schema)

        for batch in batches:
            rows = []
            coded = code([text or b"" for text in text_bytes(batch.column(1))])
            for doc_id, ids in zip(batch.column(0).to_pylist(), coded):
                rows += packer.add(doc_id, ids + end)
                if packer.full():
                    rows += packer.close(last=False)
                if len(rows) > 2000:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)
        rows = packer.close(last=True)
        for i in range(0, len(rows), 1000):
            yield batch_of(rows[i:i + 1000])
        words.forget()  # the worker lives on

    chosen = documents.select(F.col(id_col).cast("bigint").alias("doc_id"),
                              F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "doc_id bigint, start bigint, token_ids binary, "
                                  "doc_tokens bigint, sequence_id bigint, offset bigint")


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with their length and crc32 instead of their ids."""
    return pieces.select("doc_id", "start", (F.octet_length("token_ids") / 4).cast("bigint")
                         .alias("length"), F.crc32("token_ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")
