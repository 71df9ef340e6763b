"""The queries of this subpackage and the SQL that states the same result."""

from __future__ import annotations

import corpus_pipeline

from . import collocations, decontaminate, html_extract, license_scan, line_dedup, mixing, rlz, sharding, simhash, suffix_dedup, token_align, topk, toxicity

QUERIES = {
    "op1_html_extraction": html_extract.op1_html_extraction,
    "op2_license_scan": license_scan.op2_license_scan,
    "op3_benchmark_decontamination": decontaminate.op3_benchmark_decontamination,
    "op4_substring_dedup": rlz.op4_substring_dedup,
    "op5_sharding": sharding.op5_sharding,
    "op6_exact_top_k": topk.op6_exact_top_k,
    "op7_suffix_array_dedup": suffix_dedup.op7_suffix_array_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_mixing_sources": mixing.op9_mixing_sources,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
    "op11_line_dedup": line_dedup.op11_line_dedup,
    "op12_cross_tokenizer_alignment": token_align.op12_cross_tokenizer_alignment,
    "op13_phrase_collocations": collocations.op13_phrase_collocations,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {k: v for m in (collocations, decontaminate, line_dedup, mixing, rlz, sharding, topk) for k, v in m.ORACLES.items()}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
