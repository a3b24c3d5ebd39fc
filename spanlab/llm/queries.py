"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from spanlab.llm import bpe, chat_format, cotraining, html_extract, license_scan, line_dedup, minhash_dedup, mixing, parity_join, periodic_runs, quality_rules, topk_search, vector_codes

QUERIES = {
    "op1_minhash_dedup": minhash_dedup.op1_minhash_dedup,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_topk_search": topk_search.op3_topk_search,
    "op4_chat_format": chat_format.op4_chat_format,
    "op5_bpe": bpe.op5_bpe,
    "op6_html_extract": html_extract.op6_html_extract,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_cotraining": cotraining.op8_cotraining,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_mixing": mixing.op10_mixing,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_jaccard_join": parity_join.op13_jaccard_join,
}

#: Queries that SQL can express; the others are tested against brute force, a round trip or held-out labels.
ORACLE_SQL = {
    "op4_chat_format": chat_format.sql(),
    "op7_quality_rules": quality_rules.sql(),
    "op9_line_dedup": line_dedup.sql(),
    "op12_vector_codes": vector_codes.sql(),
}
