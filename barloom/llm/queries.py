"""The queries of the training-data operators and their SQL."""

from . import align, chat, decontaminate, embeddings, htmltext, langid, mixing, quality, rules, simhash, substring, toxicity, trie

QUERIES = {
    "op1_simhash_near_dedup": simhash.op1,
    "op2_language_id": langid.op2,
    "op3_quality": quality.op3,
    "op4_decontaminate": decontaminate.op4,
    "op5_substring_dedup": substring.op5,
    "op6_embedding_near_dup": embeddings.op6,
    "op7_toxicity": toxicity.op7,
    "op8_mix_sources": mixing.op8,
    "op9_chat_format": chat.op9,
    "op10_html_text": htmltext.op10,
    "op11_prefix_trie": trie.op11,
    "op12_quality_rules": rules.op12,
    "op13_align_tokenizers": align.op13,
}
#: The others can't be expressed in SQL; tests/llm compares them with brute force.
ORACLE_SQL: dict[str, str] = {
    "op5_substring_dedup": substring.OP5_SQL,
    "op6_embedding_near_dup": embeddings.OP6_SQL,
    "op9_chat_format": chat.OP9_SQL,
    "op11_prefix_trie": trie.OP11_SQL,
    "op12_quality_rules": rules.OP12_SQL,
}
