"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

import corpus_pipeline
from tidemark.llm import chat, decontamination, exact_dedup, language_id, lm_scoring, mixing, periodic_runs, private_data, simhash, structure_repair, substring_dedup, toxicity, warc

QUERIES = {
    "op1_pseudo_likelihood": lm_scoring.op1_pseudo_likelihood,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_perspective_rotation": chat.op3_perspective_rotation,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_language_id": language_id.op5_language_id,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_warc": warc.op8_warc,
    "op9_simhash_components": simhash.op9_simhash_components,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_structure_repair": structure_repair.op11_structure_repair,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_private_data": private_data.op13_private_data,
    "pipeline": corpus_pipeline.run,
}
#: The others are tested against brute force or held-out rows.
ORACLE_SQL = {
    "op2_decontamination": decontamination.OP2_SQL,
    "op3_perspective_rotation": chat.OP3_SQL,
    "op6_substring_dedup": substring_dedup.OP6_SQL,
    "op7_mix_sources": mixing.OP7_SQL,
    "op8_warc": warc.OP8_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
}
