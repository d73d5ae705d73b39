"""Registered queries of the subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from serupa.llm import decontaminate, language_net, lexical_search, license_scan, main_text, one_bit_search, pii_field, prefix_trie, secret_scan, simhash, source_mix, toxicity, wordpiece_counts

QUERIES = {
    "op1_license_scan": license_scan.op1,
    "op2_one_bit_search": one_bit_search.op2,
    "op3_source_mix": source_mix.op3,
    "op4_wordpiece_counts": wordpiece_counts.op4,
    "op5_secret_scan": secret_scan.op5,
    "op6_language_net": language_net.op6,
    "op7_pii_field": pii_field.op7,
    "op8_toxicity": toxicity.op8,
    "op9_decontaminate": decontaminate.op9,
    "op10_simhash": simhash.op10,
    "op11_lexical_search": lexical_search.op11,
    "op12_main_text": main_text.op12,
    "op13_prefix_trie": prefix_trie.op13,
}

ORACLE = {
    "op1_license_scan": license_scan.OP1_SQL,
    "op3_source_mix": source_mix.OP3_SQL,
    "op9_decontaminate": decontaminate.OP9_SQL,
    "op11_lexical_search": lexical_search.OP11_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
