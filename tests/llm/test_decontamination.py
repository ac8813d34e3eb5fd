"""Winnowed benchmark decontamination against a plain search for every window."""

import hashlib
import random
import re

import pytest

from tests.compare import connect, difference
from tillworks.llm import decontamination
from tillworks.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
NAME = "op13_benchmark_winnowing"


def plain_words(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute_force(documents, items):
    out = []
    for doc_id, text in documents:
        own, hit, met = plain_words(text), set(), set()
        for item, item_text in items:
            found = plain_words(item_text)
            n = min(len(found), decontamination.WINDOW)
            windows = {tuple(found[i:i + n]) for i in range(len(found) - n + 1)} if n else set()
            for i in range(len(own) - n + 1 if n else 0):
                if tuple(own[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    met.add("" if item is None else str(item))
        out.append((doc_id, len(own), len(hit), len(met),
                    hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def result(spark, documents, items):
    left = spark.createDataFrame([(*r, "x", 1) for r in documents],
                                 "doc_id bigint, text string, mark string, start int")
    right = spark.createDataFrame([(*r, "y") for r in items],
                                  "item_id bigint, text string, words string")
    rows = decontamination.contamination(left, right).collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_query_equals_sql(spark):
    with connect(FOLDER) as con:
        assert difference(QUERIES[NAME](spark, FOLDER), con, ORACLES[NAME]) is None


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force_on_made_texts(spark, seed):
    rng = random.Random(seed)
    # few words, so that grams and windows meet in many places
    text = lambda n: " ".join(rng.choice("a b c é Dd 7".split()) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 4, 5, 7, 9, 10, 11, 30]))) for i in range(12)]
    items += [(5, items[0][1]), (40, items[1][1]), (41, items[1][1])]
    documents = [(i, text(rng.randrange(200))) for i in range(20)]
    documents += [(i, text(5) + "! " + items[i % 12][1].upper() + "\n" + text(3)) for i in range(24)]
    assert result(spark, documents, items) == brute_force(documents, items)


def test_rare_spans_of_exactly_one_window(spark):
    words = [f"w{i}" for i in range(400)]
    items = [(1, " ".join(words[:200])), (2, " ".join(words[150:300]))]
    documents = [(i, f"x {' '.join(words[i:i + 10])} y") for i in range(0, 300, 7)]
    documents += [(i, f"x {' '.join(words[i:i + 9])} y") for i in range(0, 300, 7)]
    got = result(spark, documents, items)
    assert got == brute_force(documents, items)
    assert sum(r[5] for r in got) >= 40


def test_odd_rows(spark):
    items = [(None, "one two"), (3, None), (4, ""), (5, "..."), (3, "one two"), (3, "one two")]
    documents = [(None, "One,two"), (None, None), (1, ""), (1, ""), (1, "one"), (2, "one two " * 9_000)]
    assert result(spark, documents, items) == brute_force(documents, items)
    assert result(spark, [], items) == []
    assert result(spark, documents, []) == brute_force(documents, [])


def test_words_are_counted_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "STRETCH", 8)
    items = [(1, "a b c d e f g h i j k l"), (2, "c d"), (3, "m")]
    documents = [(n, "z " * n + "a b c d e f g h i j k l m m m c d") for n in range(20)]
    assert result(spark, documents, items) == brute_force(documents, items)


def test_a_third_of_all_rows_in_one_text_and_one_window_in_all_items(spark):
    line = "the same long line of ten words stands in every row"
    items = [(i, f"{line} {i}") for i in range(60)]
    documents = [(i, line if i % 3 else f"{line} and {i} more") for i in range(90)]
    assert result(spark, documents, items) == brute_force(documents, items)
