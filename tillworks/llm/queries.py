"""The queries of this folder by name, over the whole given tables, and SQL for some."""

import importlib.util
from pathlib import Path

from tillworks.llm import (ball_tree, byte_bpe, chat, decontamination, k2_treap, lang_id, maxent_lm,
                           packing, prefix_trie, simhash, suffix_dedup, url_filter, vp_tree)
from tillworks.llm.common import crc32_remainder, read
from tillworks.llm.oracles import ORACLES  # noqa: F401

# a conversation that holds marks of other templates
MARKED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def vocabulary_file(name):
    """A vocabulary's path, from the installed package of public tokenizers."""
    found = importlib.util.find_spec("public_tokenizers")
    return str(Path(found.origin).parent / name)


def suffix_array_dedup(spark, folder):
    return suffix_dedup.digests(read(spark, folder, "documents"))


def maxent_scores(spark, folder):
    return maxent_lm.fit_and_score(read(spark, folder, "documents"))


def cost_packing(spark, folder):
    return packing.piece_digests(packing.pack(read(spark, folder, "documents"),
                                              vocabulary_file("word_bpe_49k.json"),
                                              added_tokens=True))


def compression_language(spark, folder):
    documents = read(spark, folder, "documents").select("doc_id", "text", "lang")
    known = lang_id.learn(lang_id.training_rows(documents))
    held_out = (crc32_remainder(documents["doc_id"], 5) == 0).alias("held_out")
    return lang_id.identify(documents.select("doc_id", held_out, "text"), known).drop("text")


def simhash_groups(spark, folder):
    return simhash.near_duplicates(read(spark, folder, "documents"))


def url_verdicts(spark, folder):
    return url_filter.filter_urls(read(spark, folder, "pages")).drop("score")


def ball_tree_top_k(spark, folder):
    return ball_tree.top_k(read(spark, folder, "embeddings"))


def vp_tree_nearest(spark, folder):
    return vp_tree.nearest(read(spark, folder, "embeddings"))


def byte_bpe_round_trip(spark, folder):
    return byte_bpe.round_trip(read(spark, folder, "documents"),
                               vocabulary_file("byte_bpe_multi_50k.tiktoken"))


def chat_windows(spark, folder):
    turns = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.createDataFrame(MARKED, "conv_id bigint, turn bigint, role string, text string")
    return chat.digests(chat.windows(turns.unionByName(marked)))


def k2_treap_search(spark, folder):
    return k2_treap.rank(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def conversation_trie(spark, folder):
    return prefix_trie.trie(read(spark, folder, "conversations"))


def benchmark_winnowing(spark, folder):
    return decontamination.contamination(read(spark, folder, "documents"),
                                         read(spark, folder, "benchmark"))


QUERIES = {
    "op1_suffix_array_dedup": suffix_array_dedup,
    "op2_maxent_scores": maxent_scores,
    "op3_cost_packing": cost_packing,
    "op4_compression_language": compression_language,
    "op5_simhash_groups": simhash_groups,
    "op6_url_verdicts": url_verdicts,
    "op7_ball_tree_top_k": ball_tree_top_k,
    "op8_vp_tree_nearest": vp_tree_nearest,
    "op9_byte_bpe_round_trip": byte_bpe_round_trip,
    "op10_chat_windows": chat_windows,
    "op11_k2_treap_search": k2_treap_search,
    "op12_conversation_trie": conversation_trie,
    "op13_benchmark_winnowing": benchmark_winnowing,
}
