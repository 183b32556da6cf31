"""The queries of this subpackage, and the SQL of those that SQL can express."""

from cueframe.llm import bpe, chat, decontamination, hard_negatives, html_extract, langid, line_dedup, matroska, minhash, packing, prefix_trie, suffix_dedup, toxicity

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_html_extract": html_extract.op3_html_extract,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_media": matroska.op5_media,
    "op6_language_id": langid.op6_language_id,
    "op7_near_dedup": minhash.op7_near_dedup,
    "op8_chat_format": chat.op8_chat_format,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_packing": packing.op10_packing,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_bpe": bpe.op12_bpe,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLE_SQL = {
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op8_chat_format": chat.OP8_SQL,
    "op11_prefix_trie": prefix_trie.OP11_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
