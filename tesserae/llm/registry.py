"""The queries of this subpackage and their SQL, for the entry file."""

from __future__ import annotations

from tesserae.llm import (
    chat_format,
    decontaminate,
    jaccard_join,
    line_dedup,
    mixing,
    quality_model,
    quality_rules,
    substring_dedup,
    toxicity,
    warc,
)

QUERIES = {
    "op1_jaccard_join": jaccard_join.query,
    "op2_toxicity": toxicity.query,
    "op3_decontamination": decontaminate.query,
    "op4_quality_model": quality_model.query,
    "op5_substring_dedup": substring_dedup.query,
    "op6_line_dedup": line_dedup.query,
    "op7_quality_rules": quality_rules.query,
    "op8_mixing": mixing.query,
    "op9_warc": warc.query,
    "op10_chat_format": chat_format.query,
}

ORACLES = {
    "op3_decontamination": decontaminate.oracle,
    "op7_quality_rules": quality_rules.oracle,
    "op8_mixing": mixing.oracle,
    "op9_warc": warc.oracle,
    "op10_chat_format": chat_format.oracle,
}
