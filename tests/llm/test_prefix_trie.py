"""The conversation trie against a plain trie of rebuilt conversations."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

from tests.compare import connect, difference
from tillworks.llm import prefix_trie
from tillworks.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
NAME = "op12_conversation_trie"


def brute_force(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((-math.inf if turn is None else turn, role or "", text or ""))
    own = {c: [t[1:] for t in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        whole = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
        ends[whole].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, inside in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(inside) - 1) * len(node[-1][1]) if node else 0
    return sorted((
        min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside),
        children[node], leaves[node], saved[node],
        hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
        for node, inside in members.items())


def result(spark, rows):
    frame = spark.createDataFrame(
        [(*r, "x", 1, 2) for r in rows],
        "conv_id bigint, turn bigint, role string, text string, tie string, depth int, at int")
    return sorted(tuple(r) for r in prefix_trie.trie(frame).collect())


def test_query_equals_sql(spark):
    with connect(FOLDER) as con:
        assert difference(QUERIES[NAME](spark, FOLDER), con, ORACLES[NAME]) is None


def made_rows(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(-130, 40, 3), *range(100, 160), 1000, 2003]:
        for turn in range(rng.randrange(9)):
            rows.append((conv, turn, "user" if turn % 2 else "system", rng.choice(["é😀", "b", ""])))
    # copies, prefixes of copies, null and equal turns, repeated rows
    for conv in range(300, 420):
        for turn in range(conv % 4 * 3):
            rows.append((conv, turn // 2, "user", f"same {turn}"))
    rows += [(500 + i % 3, None, None, None) for i in range(12)]
    rows += [(None, 1, "user", "nobody"), (7_000, None, "user", "first"), (7_000, 0, "user", "next")]
    return rows


def test_equals_a_plain_trie(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BIN", 3)
    monkeypatch.setattr(prefix_trie, "LINE", 4)
    rows = made_rows(1)
    assert result(spark, rows) == brute_force(rows)


def test_one_conversation_and_one_sequence_holding_a_third_each(spark):
    rows = [(100, t % 50, "user", f"{t % 40}") for t in range(1_500)]
    rows += [(c, 0, "user", "hello") for c in range(200, 1_700)]
    rows += [(c, t, "user", f"{c % 9}") for c in range(2_000, 2_300) for t in range(5)]
    assert result(spark, rows) == brute_force(rows)


def test_conversations_without_turns_of_their_own_and_empty_tables(spark):
    # what is left of a short conversation whose base is absent may be nothing
    rows = [(c, 0, "user", "x") for c in range(901, 912)]
    got = result(spark, rows)
    assert got == brute_force(rows) and got[0][1] == 0
    assert result(spark, []) == []
