"""The queries of this subpackage by name."""

from __future__ import annotations

from loomspan.llm import chat, embed_dedup, fim, html_text, langid, materialise, mixing, mtree, ngram_join, packing, pii, prefix_trie, quality


def queries():
    return {
        "op1_pii_semicrf": pii.op1_pii_semicrf,
        "op2_length_buckets": packing.op2_length_buckets,
        "op3_quality_cascade": quality.op3_quality_cascade,
        "op4_raked_mixture": mixing.op4_raked_mixture,
        "op5_multi_index": embed_dedup.op5_multi_index,
        "op6_hd_langid": langid.op6_hd_langid,
        "op7_text_density": html_text.op7_text_density,
        "op8_feistel_shards": materialise.op8_feistel_shards,
        "op9_prefix_tree_join": ngram_join.op9_prefix_tree_join,
        "op10_chat_format": chat.op10_chat_format,
        "op11_fill_in_middle": fim.op11_fill_in_middle,
        "op12_prefix_trie": prefix_trie.op12_prefix_trie,
        "op13_mtree_search": mtree.op13_mtree_search,
    }


def oracle_sql():
    return {
        "op2_length_buckets": packing.OP2_SQL,
        "op3_quality_cascade": quality.OP3_SQL,
        "op4_raked_mixture": mixing.OP4_SQL,
        "op11_fill_in_middle": fim.OP11_SQL,
        "op12_prefix_trie": prefix_trie.OP12_SQL,
        "op13_mtree_search": mtree.OP13_SQL,
    }
