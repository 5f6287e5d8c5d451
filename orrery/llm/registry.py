"""Queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from . import ann, chat, exact_substr, html_text, licenses, mixing, neardup, packing, quality_rules, urls

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_chat_prefix_tree": chat.op3_chat_prefix_tree,
    "op4_url_filter": urls.op4_url_filter,
    "op5_html_wrappers": html_text.op5_html_wrappers,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_multi_index_ann": ann.op7_multi_index_ann,
    "op8_minhash_neardup": neardup.op8_minhash_neardup,
    "op9_suffix_array_dedup": exact_substr.op9_suffix_array_dedup,
    "op10_quality_cascade": quality_rules.op10_quality_cascade,
}
#: The other queries are tested against brute force instead.
SQL = {
    "op3_chat_prefix_tree": chat.SQL_OP3,
    "op8_minhash_neardup": neardup.SQL_OP8,
    "op9_suffix_array_dedup": exact_substr.SQL_OP9,
    "op10_quality_cascade": quality_rules.SQL_OP10,
}
