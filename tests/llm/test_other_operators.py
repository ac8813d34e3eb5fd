"""Language model, address filter, vector searches, chat windows and the pipeline."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tests.compare import connect, difference
from tillworks.llm import ball_tree, chat, maxent_lm, url_filter, vector_units, vp_tree
from tillworks.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    with connect(FOLDER) as con:
        assert difference(QUERIES[name](spark, FOLDER), con, ORACLES[name]) is None


def texts_of(spark):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(
        f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]


def test_base_score_and_counts_equal_brute_force(spark):
    texts = texts_of(spark)
    counts = Counter()
    for i, text in texts:
        if zlib.crc32(str(i).encode()) % 10:
            counts.update([*text.encode().lower().split(), b" "])
    n, v = sum(counts.values()), len(counts)
    out = {r["doc_id"]: r for r in QUERIES["op2_maxent_scores"](spark, FOLDER).collect()}
    base, score = Counter(), Counter()
    for i, text in texts:
        words, r = [*text.encode().lower().split(), b" "], out[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0)
        assert (r["n_tokens"], r["train_tokens"]) == (len(words), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in words)
        assert r["base_score"] == pytest.approx(sum(
            math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words))
        base[r["held_out"]] += r["base_score"]
        score[r["held_out"]] += r["score"]
    assert score[True] > base[True] and score[False] > base[False]


def test_language_model_probabilities_sum_to_one(spark):
    rows = spark.createDataFrame([(i, f"a b c a{i % 7} b{i % 5}") for i in range(60)],
                                 "doc_id bigint, text string")
    vocabulary = maxent_lm.learn_vocabulary(maxent_lm.count_words(rows))
    coded = maxent_lm.code_texts(rows.selectExpr("doc_id", "false as held_out", "text"), vocabulary)
    shares = vocabulary.log_shares()
    weights, strengths = maxent_lm.train(coded, shares)
    assert np.abs(weights).max() > 0 and (strengths != maxent_lm.FIRST_STRENGTH).any()
    model = maxent_lm.Model(shares, weights, strengths)
    units = np.arange(maxent_lm.UNITS)
    for last, second, third in ((3, 500, maxent_lm.BEFORE_TEXT), (0, 1, 2)):
        pair = ((last << 17) + second) * 2654435761 >> 20
        before = [np.full(len(units), x) for x in (last, second, third, pair)]
        assert (10 ** model.log10(before, units)).sum() == pytest.approx(1, abs=1e-4)


def test_shared_units_hold_the_shares_of_all_other_words(spark, monkeypatch):
    monkeypatch.setattr(maxent_lm, "HEAD_WORDS", 20)
    rows = spark.createDataFrame([(" ".join(f"w{i}" for i in range(n)),) for n in range(1, 90)],
                                 "text string")
    counts = maxent_lm.count_words(rows)
    vocabulary = maxent_lm.learn_vocabulary(counts)
    ordered = sorted(((-r["c"], r["word"]) for r in counts.collect()))
    assert [vocabulary.rank[w] for _, w in ordered[:20]] == list(range(20))
    mass = defaultdict(lambda: 0.1)
    for c, word in ordered[20:]:
        mass[maxent_lm.shared_unit(word)] += 0.1 - c
    assert len(mass) > 50
    for unit, total in mass.items():
        assert vocabulary.mass[unit] == pytest.approx(total)


def plain_rows(before, unit):
    """(digit, row, way) of each feature of a token, a list per digit."""
    out = []
    for digit in range(4):
        node, way = unit % 16**digit, unit // 16**digit % 16
        first = int(maxent_lm.FAMILY_ROWS[:digit].sum(axis=1) @ 16 ** np.arange(digit))
        rows = []
        for f, size in enumerate(maxent_lm.FAMILY_ROWS[digit].tolist()):
            rows.append(first + node * size + before[f] % size)
            first += 16**digit * size
        out.append((node, rows, way))
    return out


def test_scores_equal_a_plain_model(spark):
    """More distinct words than units of their own, all steps of training in plain loops."""
    draw = random.Random(2)
    texts = [" ".join(f"w{draw.randrange(60) * draw.randrange(60)}" for _ in range(
        draw.randrange(60))) for _ in range(150)]
    texts += [" ".join(f"r{i}" for i in range(62_000)), "w3 r5 neu R61999 r61999 w4", ""]
    ids = list(range(len(texts)))
    frame = spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string")
    out = {r["doc_id"]: r for r in maxent_lm.fit_and_score(frame).collect()}
    half = {r["doc_id"]: r["half"] for r in frame.selectExpr(
        "doc_id", "pmod(xxhash64(text), 2) half").collect()}
    split = {i: [*t.encode().lower().split(), b" "] for i, t in zip(ids, texts)}
    train = [i for i in ids if zlib.crc32(str(i).encode()) % 10]
    counts = Counter()
    for i in train:
        counts.update(split[i])
    hashes = {w: maxent_lm.word_hash(w) for i in ids for w in split[i]}
    ordered = sorted(counts, key=lambda w: (-counts[w], hashes[w]))
    units = {w: u for u, w in enumerate(ordered[:61_440])}
    mass = np.full(65_536, 1e-3)
    mass[61_440:] = 0.1
    for w, u in units.items():
        mass[u] = counts[w] + 0.1
    for w in hashes:
        if w not in units:
            units[w] = 61_440 + hashes[w] % 4096
            mass[units[w]] += (counts[w] + 0.1) * (w in counts)
    assert sum(u >= 61_440 for u in units.values()) > 100
    share = [np.array([[mass[x::16 ** (d + 1)].sum() for x in range(n, 16 ** (d + 1), 16**d)]
                       for n in range(16**d)]) for d in range(3)]
    share.append(mass.reshape(16, 4096).T)
    share = [x / x.sum(axis=1, keepdims=True) for x in share]

    tokens = defaultdict(list)
    for i in ids:
        line = [69_631] * 3 + [units[w] for w in split[i]]
        for x in range(3, len(line)):
            a, b, c = line[x - 1], line[x - 2], line[x - 3]
            pair = (((a << 17) + b) * 2654435761 + 2**63) % 2**64 - 2**63 >> 20
            tokens[i].append(plain_rows((a, b, c, pair), line[x]))
    seen = [defaultdict(lambda: np.zeros(16)) for _ in (0, 1)]
    for i in train:
        for digits in tokens[i]:
            for _, rows, way in digits:
                for row in rows:
                    seen[half[i]][row][way] += 1

    def weights(row, p, sides):
        n = sum(seen[s][row] for s in sides if row in seen[s])
        n = n if np.ndim(n) else np.zeros(16)
        return np.log((n + 4 * p) / (n.sum() * p + 4 * p))

    def chances(digit, node, rows, strengths, sides):
        p = share[digit][node]
        w = np.array([weights(row, p, sides) for row in rows])
        x = p * np.exp(strengths[digit] @ w)
        return w, x / x.sum()

    strengths = np.full((4, 4), 0.5)
    for side in (0, 1):
        slope, curve = np.zeros((4, 4)), np.array([np.eye(4)] * 4)
        for i in train:
            if half[i] == side:
                for digits in tokens[i]:
                    for digit, (node, rows, way) in enumerate(digits):
                        w, x = chances(digit, node, rows, strengths, [1 - side])
                        slope[digit] += w[:, way] - w @ x
                        curve[digit] += (w * x) @ w.T - np.outer(w @ x, w @ x)
        strengths = np.clip(strengths + np.array(
            [np.linalg.solve(c, s) for c, s in zip(curve, slope)]), 0, 2)
    for i in [*range(0, 150, 7), 151, 152]:
        expected = 0.0
        for word, digits in zip(split[i], tokens[i]):
            for digit, (node, rows, way) in enumerate(digits):
                expected += math.log10(chances(digit, node, rows, strengths, [0, 1])[1][way])
            if units[word] >= 61_440:
                expected += math.log10((counts[word] + 0.1) / mass[units[word]])
        assert out[i]["score"] == pytest.approx(expected, rel=2e-3)


def test_words_of_middle_rank_have_contexts_of_their_own(spark):
    draw = random.Random(4)
    filler = [f"f{i}" for i in range(600)]
    texts = []
    for _ in range(400):
        first = draw.randrange(560)
        words = filler[first:first + 40]
        texts.append(" ".join([*words, "left", "petal", *words[:5], "right", "quartz"]
                              if draw.random() < 0.1 else words * 2))
    ids = [i for i in range(10_000) if zlib.crc32(str(i).encode()) % 10]
    asked = [i for i in range(10_000) if zlib.crc32(str(i).encode()) % 10 == 0][:4]
    probes = ["left petal", "left quartz", "right quartz", "right petal"]
    frame = spark.createDataFrame([*zip(ids, texts), *zip(asked, probes)],
                                  "doc_id bigint, text string")
    vocabulary = maxent_lm.learn_vocabulary(maxent_lm.count_words(
        frame.where(~frame["doc_id"].isin(asked))))
    assert all(vocabulary.rank[maxent_lm.word_hash(w)] >= 385 for w in (b"petal", b"quartz"))
    out = {r["doc_id"]: r["score"] - r["base_score"] for r in maxent_lm.fit_and_score(
        frame).collect()}
    gain = [out[i] for i in asked]
    assert gain[0] > gain[1] + 0.5 and gain[2] > gain[3] + 0.5


def test_language_model_on_odd_tables(spark):
    rows = [(None, None), (1, ""), (1, ""), (2, "x " * 50_000), (3, "nur hier")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, words int")
    out = maxent_lm.fit_and_score(frame).collect()
    assert sorted(r["n_tokens"] for r in out) == [1, 1, 1, 3, 50_001]
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)
    assert maxent_lm.fit_and_score(frame.where("false")).count() == 0


def test_addresses_on_odd_rows(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/1?x", "ftp://net/",
            "x://net", "http://sub.org/fr/#a", "http://example.com/de", "a://b.net/x://c.org/fr/",
            "http://A.Example.NET/en/1?x"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)],
                                  "page_id bigint, url string, host string")
    out = {r["page_id"]: r for r in url_filter.filter_urls(pages).collect()}
    assert len(out) == len(urls)
    assert [(out[i]["host"], out[i]["path"], out[i]["rule"]) for i in range(10)] == [
        ("", "", None), ("", "", None), ("", "", None), ("", "", None),
        ("a.example.net", "/en/1", "example.net/en/"), ("net", "/", "net/"), ("net", "", None),
        ("sub.org", "/fr/", "org/fr/"), ("example.com", "/de", None),
        ("b.net", "/x://c.org/fr/", "net/")]
    assert out[4]["verdict"] == "allow" and out[5]["verdict"] == "block"
    assert {r["verdict"] for r in out.values()} <= {"allow", "block"}
    assert url_filter.filter_urls(pages.where("false")).count() == 0


def test_many_rare_children_become_a_wildcard_and_bad_templates_are_blocked(spark):
    names = ["".join(c) for c in zip("abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba")]
    rows = [("h.net", f"/user/{n}/x", "block") for n in names] * 2 + [
        ("h.net", "/about/x", "allow")] * 30 + [("k.org", "/user/zz/x", None)]
    frame = spark.createDataFrame(rows, "host string, path string, rule_verdict string").withColumn(
        "shape", url_filter.shape(url_filter.F.col("path")))
    judged = {(r["host"], r["shape"]): r for r in url_filter.judge(
        url_filter.templates(frame)).collect()}
    assert judged["h.net", "/user/az/x"]["template"] == "/user/*/x"
    assert judged["h.net", "/user/az/x"]["verdict"] == "block"
    assert judged["h.net", "/about/x"]["verdict"] == "allow"


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, dim int")


@pytest.fixture()
def odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 1) for i in range(900)]
    rows += [(i, rows[0][1], 1) for i in range(900, 1100)]  # one common vector
    rows += [(2000, None, 1), (2001, [1.0, None] * 4, 1), (2002, [float("nan")] * 8, 1),
             (2003, [float("inf")] * 8, 1), (2004, [], 1), (None, rows[1][1], 1)]
    return rows


def plain_search(rows, every, k, product):
    good = [(i, v) for i, v, _ in rows if i is not None and v and all(
        x is not None and math.isfinite(x) for x in v)]
    ids = np.array([i for i, _ in good])
    matrix = np.array([v for _, v in good], np.float32).astype(float)
    out = {}
    for i, own in zip(ids, matrix):
        if i % every == 0:
            score = product(matrix, own)
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), score[j]) for j in order]
    return out


def by_query(found):
    out = defaultdict(dict)
    for r in found.collect():
        out[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    return {q: [own[i] for i in range(1, len(own) + 1)] for q, own in out.items()}


def test_ball_tree_is_exact(spark, odd_vectors, monkeypatch):
    monkeypatch.setattr(vector_units, "SHARD_VALUES", 2000)
    monkeypatch.setattr(vector_units, "BLOCK_QUERIES", 5)
    want = plain_search(odd_vectors, 100, 10, lambda m, q: np.floor(1024 * m) @ np.floor(1024 * q))
    assert by_query(ball_tree.top_k(vectors(spark, odd_vectors))) == want
    few = odd_vectors[:4]
    assert by_query(ball_tree.top_k(vectors(spark, few))) == plain_search(
        few, 100, 10, lambda m, q: np.floor(1024 * m) @ np.floor(1024 * q))
    assert ball_tree.top_k(vectors(spark, few).where("false")).count() == 0


def test_vantage_point_tree_with_factor_one_is_exact(spark, odd_vectors, monkeypatch):
    monkeypatch.setattr(vector_units, "SHARD_VALUES", 2000)
    rows = [*odd_vectors, (2005, [0.0] * 8, 1)]
    found = by_query(vp_tree.nearest(vectors(spark, rows), factor=1.0))
    want = plain_search(odd_vectors, 20, 20, lambda m, q: m @ q)
    assert found.keys() == want.keys()
    for q, own in want.items():
        assert [i for i, _ in found[q]] == [i for i, _ in own] or np.allclose(
            [s for _, s in found[q]], [s for _, s in own], rtol=0, atol=1e-12)


def test_vantage_point_tree_recall(spark):
    table = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], 0) for r in table.collect()]
    found = by_query(QUERIES["op8_vp_tree_nearest"](spark, FOLDER))
    want = plain_search(rows, 20, 20, lambda m, q: m @ q)
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in own}) for q, own in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_chat_windows_read_back(spark):
    marks = "<|end|>\n<|turn|>user\n&lt;&amp;<|past|>"
    rows = [(1, 0, "system", "be brief " + marks), *((1, i, ("user", "assistant")[i % 2],
                                                      marks * (i % 50)) for i in range(1, 1500)),
            (2, 0, "assistant", None), (2, 0, "assistant", None), (None, None, None, "x"),
            (None, 3, "assistant", "é😀"), (3, 5, "a\n<b", "t" * 20_000), (4, 0, "system", "s")]
    turns = spark.createDataFrame([(*r, 9) for r in rows],
                                  "conv_id bigint, turn bigint, role string, text string, w int")
    windows = chat.windows(turns).cache()
    out = {r["conv_id"]: r for r in chat.digests(windows).collect()}
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((-1 if turn is None else turn, role or "", text or ""))
    assert out.keys() == groups.keys()
    for conv, own in groups.items():
        own.sort()
        loss = "".join(t for _, r, t in own if r == "assistant")
        assert out[conv]["n_turns"] == len(own) and out[conv]["loss_chars"] == len(loss)
        assert out[conv]["turns_sha256"] == hashlib.sha256("".join(
            f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        assert out[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    first = windows.where("conv_id = 1")
    assert first.where(f"tokens > {chat.BUDGET}").count() == 0 and first.count() > 5
    assert all("be brief" in r["formatted"] for r in first.collect())
    assert chat.digests(chat.windows(turns.where("false"))).count() == 0


def test_hot_conversation_of_null_and_sparse_turns(spark):
    rows = [(1, None if i % 3 else i * 10_000, "user" if i % 7 else "assistant", f"t{i % 11}")
            for i in range(4000)] + [(2, 1, "assistant", "same")] * 1500 + [(3, 0, "user", "u")]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    numbered = chat.number_turns(turns).select("conv", "position").collect()
    bins = chat.number_turns(turns).groupBy("conv").agg({"position": "max"}).collect()
    assert Counter(r["conv"] for r in numbered) == {r[0]: r[1] for r in bins}
    assert len({(r["conv"], r["position"]) for r in numbered}) == len(rows)
    out = {r["conv_id"]: r for r in chat.digests(chat.windows(turns)).collect()}
    for conv in (1, 2, 3):
        own = sorted((-1 if t is None else t, r, x) for c, t, r, x in rows if c == conv)
        assert out[conv]["turns_sha256"] == hashlib.sha256("".join(
            f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        assert out[conv]["loss_chars"] == sum(len(t) for _, r, t in own if r == "assistant")


def test_a_third_of_all_vectors_with_one_id(spark, monkeypatch):
    monkeypatch.setattr(vector_units, "SHARD_VALUES", 400)
    monkeypatch.setattr(vector_units, "BLOCK_QUERIES", 3)
    draw = np.random.default_rng(5)
    rows = [(100 if i % 3 == 0 else i, draw.standard_normal(4).tolist()) for i in range(1, 600)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    ids = np.array([r[0] for r in rows])
    points = np.floor(1024 * np.array([r[1] for r in rows])).astype(np.int64)
    found = defaultdict(list)
    for r in ball_tree.top_k(frame).collect():
        found[r["query_id"]].append((-r["score"], r["vec_id"]))
    expected = defaultdict(list)
    for i, q in zip(ids, points):
        if i % 100 == 0:
            other = ids != i
            expected[i] += sorted(zip((-(points[other] @ q)).tolist(), ids[other].tolist()))[:10]
    assert len(expected[100]) > 1900
    assert {q: sorted(x) for q, x in found.items()} == {q: sorted(x) for q, x in expected.items()}
    assert vp_tree.nearest(frame, factor=1).where("query_id = 100").count() == 20 * sum(ids == 100)


def test_pipeline_keeps_clean_documents_and_their_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.columns == columns, name
        assert docs.count() > 0.8 * before, name
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert pieces.select("doc_id").distinct().count() == docs.count()


def test_pipeline_on_odd_rows(spark):
    rows = [(1, None, None, "s", None), (2, "", "en", None, 0), (2, "", "en", None, 0),
            (None, "hello there my friend", "en", "s", 21), (4, "12", "de", "s", 2),
            (5, "word " * 3000, "en", "s", 15000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, "
                                       "n_chars bigint")
    for table in (docs, docs.where("false")):
        out = table
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, FOLDER)
        assert out.count() >= 0


def doubles(spark, rows):
    return spark.createDataFrame([r[:2] for r in rows], "vec_id bigint, embedding array<double>")


def test_ball_tree_on_large_components(spark):
    rng = random.Random(9)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)], 0) for i in range(0, 900, 3)]
    rows += [(1, [3e8] * 4, 0), (2, [-3e8, 1.0, 3e8, 0.0], 0), (4, [1e200, 0.0, 0.0, 0.0], 0),
             (5, [1e306] * 4, 0), (6_000, [2e6, 0.0, 0.0, 0.0], 0), (100, [3e5] * 4, 0)]
    whole = {i: [math.floor(1024 * x) for x in v] for i, v, _ in rows if max(v) < 1e300}
    want = {}
    for q in (i for i in whole if i % 100 == 0):
        scores = [(-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q]
        want[q] = [(i, -s) for s, i in sorted(x for x in scores if abs(x[0]) < 2**63)[:10]]
    got = by_query(ball_tree.top_k(doubles(spark, rows)))
    assert {q: [(int(i), int(s)) for i, s in v] for q, v in got.items()} == want


def search_recall(table, shards, queries, k=20):
    """Recall of the search in shards, the first shard's k-th score shared with the others."""
    parts = np.array_split(np.arange(len(table)), shards)
    own = table[queries]
    run = lambda part, floor: vp_tree.search(
        part, table[part], queries, own, k, floor, vp_tree.FACTOR)
    first = run(parts[0], np.full(len(queries), -np.inf))
    found = [first, *(run(part, first.scores[:, -1]) for part in parts[1:])]
    scores = np.concatenate([b.scores for b in found], axis=1)
    ids = np.take_along_axis(np.concatenate([b.ids for b in found], axis=1),
                             np.argsort(-scores, axis=1)[:, :k], 1)
    exact = own @ table.T
    exact[np.arange(len(queries)), queries] = -np.inf
    best = np.argsort(-exact, axis=1)[:, :k]
    return np.mean([len({*a} & {*b}) / k for a, b in zip(ids, best)])


@pytest.mark.parametrize("kind", ["gaussian", "clustered"])
def test_vantage_point_tree_recall_over_ten_shards(kind):
    rng = np.random.default_rng(3)
    table = rng.standard_normal((20_000, 32))
    if kind == "clustered":
        table = 0.5 * table + rng.standard_normal((50, 32))[rng.integers(0, 50, len(table))]
    assert search_recall(table, 10, np.arange(0, 20_000, 400)) >= 0.9


@pytest.mark.parametrize("kind", ["long few", "lognormal", "heavy", "far", "short", "copies"])
def test_vantage_point_tree_finds_all_on_unequal_norms(kind):
    rng = np.random.default_rng(4)
    table = rng.standard_normal((6_000, 8))
    if kind == "long few":
        table[::997] *= 1000
    elif kind == "lognormal":
        table *= np.exp(rng.standard_normal((len(table), 1)))
    elif kind == "heavy":
        table *= 10.0 ** rng.uniform(-30, 30, (len(table), 1))
    elif kind == "far":
        table += 10
    elif kind == "short":
        table = -1e-8 * np.abs(table)
        table[0] = 1.0
    else:
        table[1::2] = table[0] * (1 + 1e-9 * rng.standard_normal((3_000, 8)))
    assert search_recall(table, 4, np.arange(0, 6_000, 60)) >= (0.97 if kind == "copies" else 1)


def test_vantage_point_tree_on_huge_components(spark):
    rows = [(i, [math.sin(i + j) * 10.0**(160 if i % 7 == 0 else 0) / 1e10 for j in range(3)], 0)
            for i in range(300)]
    found = by_query(vp_tree.nearest(doubles(spark, rows), factor=1.0))
    assert {len(v) for v in found.values()} == {20}
    for q, own in found.items():
        exact = sorted((-sum(a * b for a, b in zip(rows[q][1], v)), i) for i, v, _ in rows if i != q)
        assert math.isclose(own[0][1], -exact[0][0], rel_tol=1e-9)
