"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.compare import connect, difference
from tillworks.llm import k2_treap
from tillworks.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
NAME = "op11_k2_treap_search"


def plain_terms(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute_force(documents, items, k=10):
    counts = [(i, Counter(plain_terms(t))) for i, t in documents]
    n, words = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(plain_terms(text))
    out = []
    for item, terms in asked.items():
        found = []
        for doc, c in counts:
            if c:
                m = 10 + 90 * c.total() * n // words
                score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                            * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
                if score > 0:
                    found.append((-score, -math.inf if doc is None else doc, doc))
        for rank, (score, _, doc) in enumerate(sorted(found, key=lambda x: x[:2])[:k], 1):
            out.append((item, rank, doc, -score))
    return sorted(out, key=str)


def result(spark, documents, items):
    left = spark.createDataFrame([(*r, 1, "x") for r in documents],
                                 "doc_id bigint, text string, n int, terms string")
    right = spark.createDataFrame([(*r, 1) for r in items], "item_id bigint, text string, w int")
    return sorted((tuple(r) for r in k2_treap.rank(left, right).collect()), key=str)


def test_query_equals_sql(spark):
    with connect(FOLDER) as con:
        assert difference(QUERIES[NAME](spark, FOLDER), con, ORACLES[NAME]) is None


def made_texts(rng, count, longest):
    words = [f"w{i}" for i in range(200)] + ["é", "ÀB", "Upper", "7", "日本"]
    return [" ".join(rng.choice(words[:rng.choice([5, 50, 205])]) for _ in range(
        rng.randrange(longest))) + "!" for _ in range(count)]


def test_equals_scoring_every_document(spark, monkeypatch):
    monkeypatch.setattr(k2_treap, "SHARD_DOCUMENTS", 37)
    monkeypatch.setattr(k2_treap, "BLOCK_TERMS", 300)
    monkeypatch.setattr(k2_treap, "ITEMS_AT_ONCE", 4)
    monkeypatch.setattr(k2_treap, "FIRST_BEAM", 2)
    rng = random.Random(5)
    documents = list(enumerate(made_texts(rng, 300, 60)))
    documents += [(7, "w1 w2"), (7, "w1 w2"), (None, "w1 w2"), (900, None), (901, ""), (902, "...")]
    # a third of all rows are copies: equal scores go by id
    documents += [(1_000 + i, "w3 w4 w5 é") for i in range(150)]
    items = list(enumerate(made_texts(rng, 40, 30)))
    items += [(None, "W3 é"), (3, "w3"), (50, None), (51, ""), (52, "nowhere")]
    assert result(spark, documents, items) == brute_force(documents, items)


def test_odd_tables(spark):
    assert result(spark, [], [(1, "a")]) == []
    assert result(spark, [(1, "a"), (2, None)], []) == []
    assert result(spark, [(1, None)], [(1, "a")]) == []
    documents = [(1, "a " * 50_000 + "b"), (2, "b"), (3, "c")]
    assert result(spark, documents, [(1, "a b")]) == brute_force(documents, [(1, "a b")])


@pytest.mark.parametrize("rows, columns", [(1, 1), (1, 40), (40, 1), (300, 20), (70, 130)])
def test_treap_alone(rows, columns):
    rng = np.random.default_rng(rows * columns)
    grid = rng.integers(1, 50, (rows, columns)) * (rng.random((rows, columns)) < 0.3)
    grid[0, 0] = 9
    at = np.nonzero(grid)
    height = max(rows - 1, columns - 1).bit_length()
    masks, maxima = k2_treap.build_treap(at[0], at[1], grid[at], height)
    treap = k2_treap.Treap(np.arange(columns), height, masks, maxima.astype(np.int64))
    assert maxima[0] == grid.max()
    best = k2_treap.Best(12, 5)
    asked = [(q, r, w) for q in range(12) for r, w in {
        int(rng.integers(rows)): int(rng.integers(1, 9)) for _ in range(6)}.items()
        if grid[r].any()]
    item, row, weight = (np.array(x, np.int64) for x in zip(*asked))
    treap.search(item, row, weight, best)
    for q in range(12):
        scores = sum((w * grid[r] for p, r, w in asked if p == q), np.zeros(columns, np.int64))
        wanted = sorted((-s, c) for c, s in enumerate(scores) if s > 0)[:5]
        mine = best.item == q
        assert list(zip(-best.score[mine], best.id[mine])) == wanted
