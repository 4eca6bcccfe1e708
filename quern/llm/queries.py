"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from quern.llm import chat_format, conversation_repair, decontaminate, divergence_audit, line_dedup, lm_scoring, minmax_dedup, packing, pii, quality_rules, resharding, sentencepieces, url_rules

QUERIES = {
    "op1_minmax_dedup": minmax_dedup.op1_minmax_dedup,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_sentencepieces": sentencepieces.op3_sentencepieces,
    "op4_resharding": resharding.op4_resharding,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_lm_scoring": lm_scoring.op6_lm_scoring,
    "op7_chat_format": chat_format.op7_chat_format,
    "op8_url_rules": url_rules.op8_url_rules,
    "op9_pii": pii.op9_pii,
    "op10_quality_rules": quality_rules.op10_quality_rules,
    "op11_source_divergence": divergence_audit.op11_source_divergence,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_sum_of_squares_packing": packing.op13_sum_of_squares_packing,
}
SQL = {
    "op1_minmax_dedup": minmax_dedup.OP1_SQL,
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op7_chat_format": chat_format.OP7_SQL,
    "op10_quality_rules": quality_rules.OP10_SQL,
    "op11_source_divergence": divergence_audit.OP11_SQL,
    "op12_conversation_repair": conversation_repair.OP12_SQL,
}
