"""Queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from pricewise.llm import (decontaminate, hard_negatives, language_id, maxent_lm, near_dup, quality_rules, rule_ensemble, secrets, sentencepiece_codec, substring_dedup, token_align,
                           url_filter, warc)

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_rule_ensemble": rule_ensemble.op2_rule_ensemble,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_warc": warc.op5_warc,
    "op6_near_dup": near_dup.op6_near_dup,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_maxent_lm": maxent_lm.op8_maxent_lm,
    "op9_secrets": secrets.op9_secrets,
    "op10_sentencepiece": sentencepiece_codec.op10_sentencepiece,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_token_align": token_align.op12_token_align,
    "op13_language_id": language_id.op13_language_id,
}

ORACLE = {
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op3_url_filter": url_filter.OP3_SQL,
    "op4_substring_dedup": substring_dedup.OP4_SQL,
    "op5_warc": warc.OP5_SQL,
    "op6_near_dup": near_dup.OP6_SQL,
    "op7_quality_rules": quality_rules.OP7_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
}
