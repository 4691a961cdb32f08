"""The ``op<N>_<name>`` queries of this subpackage and their SQL."""

from __future__ import annotations

from motifmill.llm import conversation_repair, decontaminate, exact_topk, html_text, license_scan, merkle, near_dedup, packing, quality, quality_rules, substring_dedup, token_counts, token_files

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_html_text": html_text.op2_html_text,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_quality": quality.op7_quality,
    "op8_token_files": token_files.op8_token_files,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_license_scan": license_scan.op10_license_scan,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_exact_topk": exact_topk.op13_exact_topk,
}

#: Queries without SQL here (models, packing, HTML, tokenizers) are tested against brute force.
ORACLE_SQL = {
    "op3_decontaminate": decontaminate.SQL,
    "op4_near_dedup": near_dedup.SQL,
    "op5_substring_dedup": substring_dedup.SQL,
    "op10_license_scan": license_scan.SQL,
    "op11_conversation_repair": conversation_repair.SQL,
    "op12_merkle_manifest": merkle.SQL,
    "op13_exact_topk": exact_topk.SQL,
}
