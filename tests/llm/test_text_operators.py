"""Tokenizing, packing, language, repeated passages and near duplicates on small tables."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tillworks.llm import byte_bpe, lang_id, packing, simhash, suffix_dedup
from tillworks.llm.queries import QUERIES, vocabulary_file

ODD = [None, "", " \n\t", "a", "a", "it's 'll'll we've '' x's's'll' 12 34!!??    \x1c end",
       "Straße ÄÖ İ ǅ Σας 中文 😀😀 é", "ab" * 3000, "!" * 700, " " * 300 + "x",
       "<|endoftext|> a<|endoftext|>"]


def frame(spark, texts, first=0):
    """A table with the columns of documents and some that clash with the operators' own."""
    rows = [(first + i, t, "x", 1, 2, "k") for i, t in enumerate(texts)]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, row string, hit int, print int, key string")


@pytest.fixture(scope="module")
def fuzz():
    rng = random.Random(11)
    signs = "abst'' \n\tredvl  ''!?12éßÀİΣ中😀 \x1c"
    return ODD + ["".join(rng.choice(signs) for _ in range(rng.randrange(40)))
                  for _ in range(1500)]


def test_byte_bpe_equals_the_library(spark, fuzz):
    import public_tokenizers
    import tiktoken

    path = vocabulary_file("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                special_tokens={})
    documents = frame(spark, fuzz)
    coded = {r["doc_id"]: r for r in byte_bpe.encode(documents, path).collect()}
    digests = {r["doc_id"]: r for r in byte_bpe.round_trip(documents, path).collect()}
    decoded = {r["doc_id"]: r["decoded"] for r in byte_bpe.decode(
        byte_bpe.encode(documents, path), path).collect()}
    assert len(coded) == len(digests) == len(fuzz)
    for i, text in enumerate(fuzz):
        ids, raw = library.encode_ordinary(text or ""), (text or "").encode()
        assert coded[i]["ids"] == ids and decoded[i] == raw
        sizes = [len(library.decode_single_token_bytes(t)) for t in ids]
        assert coded[i]["offsets"] == [sum(sizes[:k]) for k in range(len(sizes))] or len(ids) > 200
        assert digests[i]["n_tokens"] == len(ids)
        assert digests[i]["ids_sha256"] == hashlib.sha256(
            ",".join(map(str, ids)).encode()).hexdigest()
        assert digests[i]["decoded_sha256"] == hashlib.sha256(raw).hexdigest()
    assert byte_bpe.round_trip(documents.where("false"), path).count() == 0


def test_scan_of_compositions_equals_stepping():
    rng = np.random.default_rng(3)
    functions = rng.integers(0, 5, 5000).astype(np.uint8)
    found = byte_bpe.compose_scan(functions)
    state = np.arange(3)
    for f, g in zip(functions, found):
        state = byte_bpe._FUNCTIONS[f][state]
        assert (byte_bpe._FUNCTIONS[g] == state).all()


def test_packing_keeps_every_id_once_and_pads_nothing(spark, fuzz):
    from tokenizers import Tokenizer

    path = vocabulary_file("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    texts = fuzz + ["word " * 9000, "lorem ipsum " * 2048]
    pieces = packing.pack(frame(spark, texts), path, group_sequences=2).collect()
    documents, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        documents[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append((p["offset"], len(p["token_ids"]) // 4))
    for i, text in enumerate(texts):
        own = sorted(documents[i], key=lambda p: p["start"])
        ids = np.frombuffer(b"".join(p["token_ids"] for p in own), "<u4").tolist()
        assert ids == [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert {p["doc_tokens"] for p in own} == {len(ids)}
        assert [p["start"] for p in own] == list(np.cumsum(
            [0, *(len(p["token_ids"]) // 4 for p in own)])[:-1])
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end == packing.SEQUENCE_TOKENS or end & (end - 1) == 0
    assert packing.pack(frame(spark, texts).where("false"), path).count() == 0


def test_packing_queries_equal_the_librarys_plain_call(spark, fuzz, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_file("word_bpe_49k.json"))
    rng = random.Random(6)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|end", "oftext|>", "x", "It's",
             "é", "e", "\u0301", " ", "\n", "12", "!", "\u2003", "日本", "<", "|>"]
    texts = ["hi <|endoftext|> you", *fuzz[:300], *(
        "".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(300))]
    documents = frame(spark, texts)
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    for pieces in (QUERIES["op3_cost_packing"](spark, str(tmp_path)),
                   corpus_pipeline.pack_sequences(spark, documents, str(tmp_path))):
        whole = {r["doc_id"]: r for r in pieces.where("length = doc_tokens").collect()}
        assert len(whole) > 0.9 * len(texts) and 0 in whole
        for i, r in whole.items():
            ids = [*library.encode(texts[i] or "", add_special_tokens=False).ids, 2]
            assert r["doc_tokens"] == len(ids), texts[i]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_takes_the_cheapest_sequence_with_room():
    documents, starts, lengths, sequences, offsets = packing.assign([6, 5, 3, 2], [8, 8])
    placed = Counter()
    for s, n in zip(sequences, lengths):
        placed[int(s)] += int(n)
    assert placed == {0: 8, 1: 8}
    assert list(zip(documents, lengths))[:2] == [(0, 6), (1, 5)] and sequences[0] != sequences[1]


def test_language_is_learned_and_narrow_leads_are_rejected(spark):
    rng = random.Random(4)
    words = {"x": ["hund", "katze", "und", "der", "baum", "schnee"],
             "y": ["chien", "chat", "le", "et", "arbre", "neige"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(5, 60))), lang)
            for i, lang in enumerate(["x", "y"] * 100)]
    rows += [(900, None, "x"), (901, "", "y"), (902, "12 !! 34", None), (903, "qqq", None)]
    documents = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    known = lang_id.learn(lang_id.training_rows(documents))
    assert [lang for lang, _ in known] and all(
        len(d) <= lang_id.DICTIONARY_BYTES + 1000 for _, d in known)
    out = {r["doc_id"]: r for r in lang_id.identify(documents, known).collect()}
    assert len(out) == len(rows)
    right = sum(out[i]["lang_pred"] == lang for i, _, lang in rows[:200])
    assert right >= 195
    assert all(0 <= r["score"] <= 1 for r in out.values())
    assert {out[i]["lang_pred"] for i in (900, 901, 902)} == {"und"}
    assert all(out[i]["rejected"] for i in (900, 901, 902)) and out[903]["lang_pred"] in "xy"
    assert lang_id.learn(documents.where("false")) == []
    assert lang_id.identify(documents, []).where("lang_pred <> 'und'").count() == 0


def test_long_and_repeated_labelled_texts_fill_a_dictionary(spark):
    rng = random.Random(5)

    def text(words, size):
        return " ".join(rng.choice(words) for _ in range(size // 7))

    long, short = (["".join(rng.choice(signs) for _ in range(6)) for _ in range(200)]
                   for signs in ("abcdeé", "uvwxyz"))
    rows = [(text(long, 30_000), "long") for _ in range(20)]
    rows += [(text(short, 300), "copied") for _ in range(150)]
    rows += [(rows[20][0], "copied")] * 8000
    training = spark.createDataFrame(rows, "text string, lang string")
    known = dict(lang_id.learn(training))
    assert {lang: len(d) > 0.8 * lang_id.DICTIONARY_BYTES for lang, d in known.items()} == {
        "long": True, "copied": True}
    assert list(known) == ["copied", "long"]
    documents = spark.createDataFrame(
        [(i, text((long, short)[i % 2], 200)) for i in range(60)], "doc_id bigint, text string")
    out = {r["doc_id"]: r for r in lang_id.identify(documents, list(known.items())).collect()}
    assert all(out[i]["lang_pred"] == ("long", "copied")[i % 2] for i in range(60))


def passages(rng):
    def text(n):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz é") for _ in range(n))

    shared = [text(rng.choice([150, 198, 200, 203, 260, 600])) for _ in range(20)]
    texts = []
    for _ in range(120):
        own = text(rng.choice([0, 50, 300]))
        for _ in range(rng.randrange(4)):
            part = rng.choice(shared)
            own += part[rng.randrange(40):len(part) - rng.randrange(40)] + text(
                rng.choice([0, 8, 64]))
        texts.append(own)
    base = text(500)
    texts += [text(30) + (base[:d] * 300)[:n] + text(60) for d in (1, 3, 10, 150, 190)
              for n in (205, 260, 420)]
    hot = text(500)
    texts += [text(rng.randrange(20, 90)) + hot[rng.randrange(200):500 - rng.randrange(100)]
              + text(rng.randrange(20, 90)) for _ in range(90)]
    return texts + texts[:10] + [None, "", "x" * 199, "x" * 200, "x" * 201, "y" * 200]


@pytest.mark.parametrize("unit", [256, 20])
def test_repeated_passages_equal_brute_force(spark, monkeypatch, unit):
    monkeypatch.setattr(suffix_dedup, "UNIT_CONTEXTS", unit)
    texts = passages(random.Random(5))
    documents = frame(spark, texts).selectExpr("if(doc_id % 50 = 0, null, doc_id) as doc_id",
                                               "text", "row", "hit", "key")
    got = Counter(tuple(r) for r in suffix_dedup.digests(documents).collect())
    want = suffix_dedup.brute_force([(t or "").encode() for t in texts])
    assert got == Counter((i if i % 50 else None, *w) for i, w in enumerate(want))


def test_repeated_passages_of_equal_rows_and_none(spark):
    rows = frame(spark, ["z" * 50 + "abc" * 90]).selectExpr("*").unionByName(
        frame(spark, ["z" * 50 + "abc" * 90]))
    out = suffix_dedup.without_repeats(rows)
    assert out.columns == rows.columns and [r["text"] for r in out.collect()] == ["", ""]
    assert suffix_dedup.digests(rows.where("false")).count() == 0
    nothing = suffix_dedup.without_repeats(frame(spark, [None, "ü" * 20])).orderBy("doc_id")
    assert [r["text"] for r in nothing.collect()] == [None, "ü" * 20]


def plain_components(prints):
    values = np.array(sorted(set(prints)), np.int64)
    near = np.bitwise_count(values[:, None].view(np.uint64) ^ values.view(np.uint64)[None, :]) <= 4
    least = values.copy()
    while True:
        new = np.where(near, least[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (new == least).all():
            return dict(zip(values.tolist(), least.tolist()))
        least = new


@pytest.mark.parametrize("block", [512, 40])
def test_pigeonring_loses_no_link(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(7)
    values = set()
    for size in [1] * 30 + [4] * 20 + [300]:
        centre = rng.getrandbits(64)
        for _ in range(size):
            x = centre
            for bit in rng.sample(range(64), rng.randrange(6)):
                x ^= 1 << bit
            values.add(x - (1 << 64) if x >> 63 else x)
    found = {r["print"]: r["root"] for r in simhash.groups(
        spark.createDataFrame([(v,) for v in values], "print bigint")).collect()}
    assert found == plain_components(values)


def plain_print(text):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    texts = [None, "", "One", "one", "one two", "One  TWO", "a b c d"]
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([6, 80, 400]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            near = list(base)
            near[rng.randrange(len(near))] = rng.choice(words)
            texts.append(" ".join(near))
    out = {r["doc_id"]: r for r in simhash.near_duplicates(frame(spark, texts, 1)).collect()}
    prints = [plain_print(t) for t in texts]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    root = plain_components(signed)
    least = {}
    for i, p in enumerate(signed):
        least.setdefault(root[p], i + 1)
    for i, p in enumerate(signed):
        assert out[i + 1]["fingerprint"] == f"{prints[i]:016x}"
        assert out[i + 1]["component_id"] == least[root[p]]
    kept = simhash.keep_one(frame(spark, texts, 1))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())
    assert simhash.near_duplicates(frame(spark, texts).where("false")).count() == 0


def test_one_of_equal_rows_stays(spark):
    rows = spark.createDataFrame([(5, "same words here again"), (5, "same words here again"),
                                  (None, "same words here again"), (None, "quite other text")],
                                 "doc_id bigint, text string")
    assert sorted(map(str, simhash.keep_one(rows).collect())) == sorted(map(str, [
        rows.collect()[0], rows.collect()[3]]))


def test_word_ids_equal_the_librarys_across_generations_of_the_cache(monkeypatch):
    from tokenizers import Tokenizer

    path = vocabulary_file("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    monkeypatch.setattr(packing, "_CACHE_WORDS", 40)
    words = packing.WordVocabulary(path)
    rng = random.Random(5)
    parts = ["don't", "'s", "rock'star", "ÉTÉ", "été!!", "x", "Abc", ".%%%", "&&&", "12a", "…", "'", "ß'll",
             "×", "a×b", "日本", "é", "İ", "ǅ.", "-", "we've,", "''t", "!'t", "naïve?!", " "]
    for _ in range(60):
        texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(30))
                 for _ in range(3)]
        got = words.ids([text.encode() for text in texts])
        for text, ids in zip(texts, got):
            expected = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == expected, text


def plain_languages(rows):
    """The rows that language ID keeps, each classified alone."""
    import xxhash

    texts, size, pieces = Counter(), Counter(), defaultdict(dict)
    training = [r for r in rows if r["lang"] is not None and r["text"]
                and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    texts.update(r["lang"] for r in training)
    distinct = {(r["lang"], r["text"].encode()) for r in training}
    for lang, raw in distinct:
        size[lang] += len(raw)
    for lang, raw in distinct:
        key = xxhash.xxh64_intdigest(xxhash.xxh64_intdigest(raw, 42).to_bytes(8, "little"), 42)
        for at in range(0, len(raw), 2048):
            value = xxhash.xxh64_intdigest(at.to_bytes(4, "little"), key) >> 2
            if value <= min(1.0, 4 * 32768 / size[lang]) * (1 << 62):
                pieces[lang][value] = lang_id.letters(raw[at:at + 2048].decode(errors="ignore"))
    known = []
    for lang in sorted(texts, key=lambda lang: (-texts[lang], lang)):
        own = []
        for _, piece in sorted(pieces[lang].items()):
            if piece and sum(map(len, own)) + len(piece) <= 32768:
                own.append(piece)
        known.append((lang, b" ".join(own)))
    classifier = lang_id.Classifier(known)
    return [r for r in rows if not classifier.predict(r["text"])[2]]


def plain_first_of_groups(rows):
    prints = [plain_print(r["text"]) for r in rows]
    prints = [p - (1 << 64) if p >> 63 else p for p in prints]
    root, first = plain_components(prints), {}
    for p, r in sorted(zip(prints, rows), key=lambda x: x[1]["doc_id"]):
        first.setdefault(root[p], r)
    return list(first.values())


def plain_cut(rows, length=200):
    texts = [(r["text"] or "").encode() for r in rows]
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for text, r in zip(texts, rows):
        gone = bytearray(len(text))
        for i in range(len(text) - length + 1):
            if seen[text[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(text, gone) if not g).decode(errors="ignore")
        out.append(r | {"text": kept, "n_chars": len(kept)})
    return out


def test_pipeline_stages_equal_plain_versions(spark):
    from tokenizers import Tokenizer

    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [r.asDict() for r in table.collect()]
    assert len({r["doc_id"] for r in rows}) == len(rows)
    top = max(r["doc_id"] for r in rows)
    more = [(rows[3]["text"], "en"), (rows[5]["text"] + " one more word", "en"), ("12 !! 34", None),
            ("", "de"), (None, None), ("qx", None), ("uno due " + rows[7]["text"][:700], None),
            ("fin " + rows[7]["text"][100:900] + "é" * 150 + " new", None)]
    rows += [{"doc_id": top + 1 + i, "text": text, "lang": lang, "source": "s",
              "n_chars": len(text or "")} for i, (text, lang) in enumerate(more)]
    plain = [plain_languages, plain_first_of_groups, plain_cut]
    sizes = [len(rows)]
    for (name, stage), version in zip(corpus_pipeline.STAGES, plain):
        found = [r.asDict() for r in stage(
            spark, spark.createDataFrame(rows, table.schema), None).collect()]
        rows = sorted(version(rows), key=lambda r: r["doc_id"])
        assert sorted(found, key=lambda r: r["doc_id"]) == rows, name
        sizes.append(len(rows))
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3]
    library = Tokenizer.from_file(vocabulary_file("word_bpe_49k.json"))
    pieces = defaultdict(list)
    for r in corpus_pipeline.STAGES[3][1](
            spark, spark.createDataFrame(rows, table.schema), None).collect():
        pieces[r["doc_id"]].append(r)
    assert pieces.keys() == {r["doc_id"] for r in rows}
    for r in rows:
        ids = np.array([*library.encode(r["text"], add_special_tokens=False).ids, 2], "<u4")
        end = 0
        for p in sorted(pieces[r["doc_id"]], key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (end, len(ids))
            end += p["length"]
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"]:end].tobytes())
        assert end == len(ids)
