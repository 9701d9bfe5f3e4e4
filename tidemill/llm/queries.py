"""The package's registered queries and their SQL."""

from __future__ import annotations

from tidemill.llm import (
    chat, decontaminate, exact_dedup, fim, licenses, line_dedup, near_dedup, packing, pii,
    quality, secrets, source_audit, token_counts,
)

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_quality": quality.op3_quality,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_licenses": licenses.op5_licenses,
    "op6_secrets": secrets.op6_secrets,
    "op7_packing": packing.op7_packing,
    "op8_pii": pii.op8_pii,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_chat": chat.op10_chat,
    "op11_token_counts": token_counts.op11_token_counts,
    "op12_fill_in_middle": fim.op12_fill_in_middle,
    "op13_source_audit": source_audit.op13_source_audit,
}

# The others can't be put in SQL (positions of pattern matches, trees, alignment, tokens, SimHashes):
# tests hold them against brute force.
ORACLES = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op4_near_dedup": near_dedup.SQL,
    "op10_chat": chat.SQL,
    "op12_fill_in_middle": fim.SQL,
    "op13_source_audit": source_audit.SQL,
}
