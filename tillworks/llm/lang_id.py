"""Language identification by compression.

For every language a zstandard dictionary of raw content is made from labelled texts.
A text is compressed block by block with each dictionary; the language with the smallest
total wins, and the lead over the second smallest is the score. Before that, texts
are lower-cased and every run of signs that are no letters becomes one space.

The dictionaries come from a bounded sample: per language ``DICTIONARY_BYTES`` of pieces of
at most ``PIECE_BYTES`` of the distinct training texts of any length, taken in the order of a
hash of text and position. All other work covers all rows and whole texts; nothing but text is
looked at.

A null text, or one without a letter, is `und` with score 0 and rejected. With a single
learned language every other text gets it with score 1; with none, `und`. Equal sizes go to
the language with more training texts, then to the first by name, and are rejected as the
lead is narrow. Repeated rows get equal results, an empty table gives an empty table, other
columns are ignored.
"""

import functools

import pyarrow as pa
import regex
import zstandard

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillworks.llm.common import crc32_remainder, schema_with, small_batches

DICTIONARY_BYTES = 32 << 10
PIECE_BYTES = 2 << 10
BLOCK_BYTES = 2048
LEVEL = 6
# a lead of less than this share of the second smallest size is narrow
NARROW_LEAD = 0.002
UNDETERMINED = "und"
_NO_LETTERS = regex.compile(r"[^\p{L}]+")


def letters(text: str) -> bytes:
    return _NO_LETTERS.sub(" ", text.lower()).strip().encode()


def training_rows(documents: DataFrame, id_col="doc_id", lang_col="lang", folds=5) -> DataFrame:
    """Rows with a language whose id falls in a fold that is not held out."""
    return documents.where(F.col(lang_col).isNotNull()
                           & (crc32_remainder(F.col(id_col), folds) != 0))


def learn(training: DataFrame, text_col="text", lang_col="lang") -> list:
    """(language, dictionary bytes), those with most texts first.

    What reaches the driver is bounded by the number of languages times a few dictionaries.
    """
    rows = training.select(F.col(lang_col).cast("string").alias("lang"),
                           F.col(text_col).cast("string").alias("text")).where(
        (F.octet_length("text") > 0) & F.col("lang").isNotNull())
    rows = rows.withColumn("key", F.xxhash64("text"))
    totals = {r["lang"]: r for r in rows.groupBy("lang", "key").agg(
        F.count("*").alias("texts"), F.max(F.octet_length("text")).cast("bigint").alias(
            "size")).groupBy("lang").agg(F.sum("texts").alias("texts"),
                                         F.sum("size").alias("size")).collect()}
    # a hash below the share keeps about four dictionaries' worth of each language
    limits = [F.when(F.col("lang") == lang, F.lit(int(min(1.0, 4 * DICTIONARY_BYTES / r["size"])
                                                      * (1 << 62))))
              for lang, r in totals.items()]
    sample = {}
    if limits:
        def hashed(at):
            return F.shiftrightunsigned(F.xxhash64("key", at), 2)

        starts = F.sequence(F.lit(0), F.octet_length("text") - 1, F.lit(PIECE_BYTES))
        chosen = rows.withColumn("share", F.coalesce(*limits)).select(
            "lang", "key", "text", F.explode(F.filter(
                starts, lambda at: hashed(at) <= F.col("share"))).alias("at")).select(
            "lang", hashed(F.col("at")).alias("hash"), F.substring(
                F.col("text").cast("binary"), F.col("at") + 1, F.lit(PIECE_BYTES)).alias("piece"))
        found = chosen.groupBy("lang", "hash").agg(F.first("piece").alias("piece"))
        for r in sorted(found.collect(), key=lambda r: r["hash"]):
            own = sample.setdefault(r["lang"], [])
            # a cut may split a character
            text = letters(bytes(r["piece"]).decode(errors="ignore"))
            if text and sum(map(len, own)) + len(text) <= DICTIONARY_BYTES:
                own.append(text)
    order = sorted(totals, key=lambda lang: (-totals[lang]["texts"], lang))
    return [(lang, b" ".join(sample.get(lang, []))) for lang in order]


class Classifier:
    def __init__(self, dictionaries):
        self._coders = []
        for lang, content in dictionaries:
            # the compressor wants eight bytes at least
            data = zstandard.ZstdCompressionDict(content.ljust(8),
                                                 dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self._coders.append((lang, zstandard.ZstdCompressor(
                level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False,
                write_dict_id=False)))

    def sizes(self, text: bytes):
        blocks = [text[i:i + BLOCK_BYTES] for i in range(0, len(text), BLOCK_BYTES)]
        return [sum(len(coder.compress(b)) for b in blocks) for _, coder in self._coders]

    def predict(self, text):
        """(language, score, rejected) of a text or None."""
        content = letters(text or "")
        if not content or not self._coders:
            return UNDETERMINED, 0.0, True
        sizes = self.sizes(content)
        best = min(range(len(sizes)), key=sizes.__getitem__)  # the first of equals
        rest = sizes[:best] + sizes[best + 1:]
        score = 1.0 - sizes[best] / min(rest) if rest else 1.0
        return self._coders[best][0], score, score < NARROW_LEAD


@functools.lru_cache(maxsize=2)
def _classifier(dictionaries):
    return Classifier(dictionaries)


def identify(documents: DataFrame, dictionaries: list, text_col="text") -> DataFrame:
    """All rows and columns, with lang_pred, score and rejected added (or replaced)."""
    small_batches(documents.sparkSession)
    added = ["lang_pred", "score", "rejected"]
    kept = [c for c in documents.columns if c.lower() not in added]
    frame = documents.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text_col)
    known = tuple(dictionaries)

    def run(batches):
        classifier = _classifier(known)
        for batch in batches:
            found = [classifier.predict(t) for t in batch.column(at).to_pylist()]
            columns = [pa.array([f[i] for f in found], kind)
                       for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.record_batch([*batch.columns, *columns], [*batch.schema.names, *added])

    return frame.mapInArrow(run, schema_with(frame, lang_pred="string", score="double",
                                             rejected="boolean"))
