"""Queries of this package for the driver's registry."""

from __future__ import annotations

from loxodrome.llm import decontam, substring_dedup
from loxodrome.llm.decontam import op5_benchmark_decontamination
from loxodrome.llm.langid import op8_language_id
from loxodrome.llm.mixing import op3_mix_sources
from loxodrome.llm.near_dup import op6_minhash_near_dedup
from loxodrome.llm.pii import op7_personal_data
from loxodrome.llm.quality_cnn import op2_quality_classifier
from loxodrome.llm.quality_rules import op10_quality_rules
from loxodrome.llm.substring_dedup import op9_substring_dedup
from loxodrome.llm.suffix_dedup import op1_suffix_array_dedup
from loxodrome.llm.toxicity import op4_toxicity

QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_mix_sources": op3_mix_sources,
    "op4_toxicity": op4_toxicity,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_personal_data": op7_personal_data,
    "op8_language_id": op8_language_id,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_quality_rules": op10_quality_rules,
}

ORACLES: dict[str, str] = {"op5_benchmark_decontamination": decontam.ORACLE, "op9_substring_dedup": substring_dedup.ORACLE}
