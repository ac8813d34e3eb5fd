"""Benchmark decontamination by winnowed fingerprints, with DataFrame functions only.

Words are the maximal runs of a-z, 0-9 and non-ASCII characters after A-Z are lower-cased. Every
``WINDOW`` consecutive words of an item are a window; an item of fewer words is one window.
Winnowing keeps of every window the least hash of its ``GRAM``-word grams as its mark. Equal
windows have equal marks, so no shared span of ``WINDOW`` words can be missed. Marks of documents
are joined with marks of items, and a meeting is extended to the whole window: two 64-bit
hashes of all its words have to be equal as well. Words under a window so found are hit.
Items shorter than ``GRAM`` words have one gram of all their words.

Each text is split once. A bit table of fixed size keeps marks that no item has out of the
shuffle; where the benchmark is so large that the table fills up, it only stops saving shuffle.
Documents of equal text are looked up once. Windows that occur in the same items form a set, and
documents that meet the same sets share one list of items, so long lists are made once. Words
under windows are counted in stretches of ``STRETCH`` words.

Null texts count as empty, null ids of items as empty strings. Rows of one item id are one item;
every row of documents gives one row, repeated rows and ids included. Empty tables give no
rows, or rows without hits. Other columns are ignored.
"""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillworks.llm.common import among
from tillworks.session import cut_lineage

WINDOW = 10
GRAM = 5
STRETCH = 4096
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ["mark", "one", "two", "length"]


def words(text):
    plain = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(plain, SEPARATORS), "")


def _at(array, place):
    return F.get(F.col(array), place)


def starts(rows: DataFrame, length: int) -> DataFrame:
    """A row per window of ``length`` words, by its start, with its mark; and one of start -1.

    ``rows`` has an array ``words``; it stays in every row beside the other columns.
    """
    gram = min(GRAM, length)
    grams = F.transform("words", lambda w, i: F.xxhash64(w, *[
        _at("words", i + n) for n in range(1, gram)]))
    places = F.concat(F.array(F.lit(-1)), F.when(
        F.size("words") >= length, F.sequence(F.lit(0), F.size("words") - length)).otherwise(
        F.array().cast("array<int>")))
    inside = [_at("grams", F.col("start") + n) for n in range(length - gram + 1)]
    return rows.withColumn("grams", grams).withColumn("start", F.explode(places)).withColumn(
        "mark", F.least(*inside) if len(inside) > 1 else inside[0]).drop("grams")


def extend(marked: DataFrame, length: int) -> DataFrame:
    """The whole windows of marks: two hashes of all their words instead of the words."""
    whole = [_at("words", F.col("start") + n) for n in range(length)]
    return marked.withColumns({"one": F.xxhash64(*whole), "two": F.xxhash64(F.lit(1), *whole),
                               "length": F.lit(length)}).drop("words")


def _fingerprint(column):
    """A hash of a set of distinct strings that any task can build in part."""
    return [F.count("*").alias("n"), F.bit_xor(F.xxhash64(column)).alias("x"),
            F.bit_xor(F.xxhash64(F.lit(1), column)).alias("y")]


def _named_sets(rows: DataFrame, owner: list, member: str, name: str):
    """Owners of equal sets of members share a name: (owner, name), and (name, member)."""
    named = cut_lineage(rows.groupBy(*owner).agg(*_fingerprint(member)).select(
        *owner, F.concat_ws(":", "n", "x", "y").alias(name)))
    first = cut_lineage(named.groupBy(name).agg(F.min(F.struct(*owner)).alias("o")).select(
        name, "o.*"))
    return named, cut_lineage(rows.join(first, owner).select(name, member))


def item_windows(items: DataFrame) -> tuple[DataFrame, DataFrame, list]:
    """Windows (mark, one, two, length, text) of distinct texts, (text, item), and the lengths."""
    read = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                        words("text").alias("words"))
    read = cut_lineage(read.select("item", "words", F.md5(F.array_join("words", " ")).alias(
        "text")).where(F.size("words") > 0))
    # at most WINDOW numbers
    lengths = sorted(r[0] for r in read.select(
        F.least(F.size("words"), F.lit(WINDOW))).distinct().collect())
    found = [extend(starts(read.where(
        F.least(F.size("words"), F.lit(WINDOW)) == n).select("text", "words"), n), n).where(
        "start >= 0").select(*_KEY, "text") for n in lengths]
    empty = extend(starts(read.where("false").select("text", "words"), WINDOW), WINDOW).select(
        *_KEY, "text")
    windows = cut_lineage(reduce(DataFrame.unionByName, found, empty).distinct())
    return windows, read.select("text", "item").distinct(), lengths


def document_windows(documents: DataFrame, windows: DataFrame, lengths: list) -> DataFrame:
    """Windows of documents whose marks may be an item's, and a row of start -1 per document."""
    read = documents.select(
        "doc_id", F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("same"),
        words("text").alias("words")).withColumn("n_words", F.size("words").cast("bigint"))

    def of(length):
        marked = starts(read, length)
        wanted = windows.where(F.col("length") == length).select("mark")
        return extend(among(marked, "mark", wanted, also="start = -1"), length)

    found = [of(WINDOW), *(of(n).where("start >= 0") for n in lengths if n < WINDOW)]
    return cut_lineage(reduce(DataFrame.unionByName, found))


def covered(spans: DataFrame, key: str) -> DataFrame:
    """Per key the number of places under the spans (start, length), as n_hit."""
    cell = spans.withColumn("stretch", F.explode(F.sequence(
        F.floor(F.col("start") / STRETCH), F.floor((F.col("start") + F.col("length") - 1) / STRETCH))))
    cut = cell.select(
        key, "stretch", F.greatest(F.col("start"), F.col("stretch") * STRETCH).alias("a"),
        F.least(F.col("start") + F.col("length"), (F.col("stretch") + 1) * STRETCH).alias("b"))
    before = Window.partitionBy(key, "stretch").orderBy("a").rowsBetween(
        Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("b") - F.greatest(F.col("a"), F.coalesce(
        F.max("b").over(before), F.col("a"))))
    return cut.groupBy(key, "stretch", "a").agg(F.max("b").alias("b")).withColumn(
        "fresh", fresh).groupBy(key).agg(F.sum("fresh").cast("bigint").alias("n_hit"))


def contamination(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, a row per document.

    ``documents`` has doc_id and text, ``items`` item_id and text.
    """
    windows, members, lengths = item_windows(items)
    window_sets, set_texts = _named_sets(windows, _KEY, "text", "shared")
    rows = document_windows(documents, windows, lengths)
    hits = cut_lineage(rows.where("start >= 0").select("same", "start", *_KEY).distinct().join(
        window_sets, _KEY).select("same", "start", "length", "shared"))
    n_hit = covered(hits, "same")
    lists, list_sets = _named_sets(hits.select("same", "shared").distinct(), ["same"], "shared",
                                   "list")
    # the digest needs the ids of one list in one row
    named = list_sets.join(set_texts, "shared").select("list", "text").distinct().join(
        members, "text").select("list", "item").distinct().groupBy("list").agg(
        F.count("*").alias("n_items"), F.sha2(F.array_join(F.sort_array(F.collect_list(
            "item")), ","), 256).alias("items_sha256"))
    by_text = cut_lineage(n_hit.join(lists, "same").join(named, "list").drop("list"))
    none = F.lit(0).cast("bigint")
    return rows.where("start = -1").select("doc_id", "same", "n_words").join(
        by_text, "same", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", none).alias("n_hit"),
        F.coalesce("n_items", none).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"))
