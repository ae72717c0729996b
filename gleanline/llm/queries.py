"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from gleanline.llm import op1_decontamination, op10_jaccard, op11_chat, op12_prefix_trie, op13_whitening, op2_lines, op3_sharding, op4_quality, op5_packing, op6_pii, op7_extraction, op8_warc, op9_toxicity, oracles

QUERIES = {
    "op1_decontamination": op1_decontamination.query,
    "op2_lines": op2_lines.query,
    "op3_sharding": op3_sharding.query,
    "op4_quality": op4_quality.query,
    "op5_packing": op5_packing.query,
    "op6_pii": op6_pii.query,
    "op7_extraction": op7_extraction.query,
    "op8_warc": op8_warc.query,
    "op9_toxicity": op9_toxicity.query,
    "op10_jaccard": op10_jaccard.query,
    "op11_chat": op11_chat.query,
    "op12_prefix_trie": op12_prefix_trie.query,
    "op13_whitening": op13_whitening.query,
    "quality_ablation": op4_quality.ablation_query,
}
ORACLES = {
    "op8_warc": op8_warc.ORACLE,
    "op2_lines": op2_lines.ORACLE,
    "op1_decontamination": oracles.DECONTAMINATION,
    "op4_quality": oracles.QUALITY,
    "quality_ablation": oracles.ABLATION,
    "op10_jaccard": oracles.JACCARD,
    "op12_prefix_trie": op12_prefix_trie.ORACLE,
}
