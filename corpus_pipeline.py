"""Language ID, near-duplicate removal, repeated passages, packing: documents to sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written to the shared
folder and read again as the next stage's docs. All but the last return the columns of
documents. Texts may be null or empty, rows repeated, the table empty; what each stage then
does is said in its operator's module.
"""

from pyspark.sql import functions as F

from tillworks.llm import lang_id, packing, simhash, suffix_dedup
from tillworks.llm.common import read
from tillworks.llm.queries import vocabulary_file
from tillworks.session import cut_lineage


def identify_language(spark, docs, sf_dir):
    """Drops documents without a letter and those whose two best languages are too close."""
    known = lang_id.learn(lang_id.training_rows(docs))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return lang_id.identify(own, known).where("not rejected").select("row.*")


def drop_near_duplicates(spark, docs, sf_dir):
    """Keeps the document of the smallest id of each SimHash group."""
    return simhash.keep_one(docs)


def cut_repeated_passages(spark, docs, sf_dir):
    """Cuts strings of 200 bytes and more that occur elsewhere out of the texts."""
    cut = suffix_dedup.without_repeats(docs)
    if "n_chars" not in docs.columns:
        return cut
    kind = docs.schema["n_chars"].dataType
    return cut.withColumn("n_chars", F.char_length("text").cast(kind))


def pack_sequences(spark, docs, sf_dir):
    """Pieces of documents with their sequence and place."""
    return packing.piece_digests(packing.pack(docs, vocabulary_file("word_bpe_49k.json"),
                                              added_tokens=True))


STAGES = [("language ID", identify_language), ("SimHash near-dedup", drop_near_duplicates),
          ("suffix-array dedup", cut_repeated_passages), ("packing", pack_sequences)]
# tokenizers, SimHash and compression have no SQL
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the documents of a folder."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else cut_lineage(docs), sf_dir)
    return docs
