"""The numbered queries of this subpackage and their SQL."""

from __future__ import annotations

from decoyscope.llm import (
    decontamination,
    exact_dedup,
    html_extraction,
    language,
    line_dedup,
    manifest,
    minhash,
    packing,
    resampling,
    sharding,
    simhash,
    token_counts,
    toxicity,
)

QUERIES = {
    "op1_html_extraction": html_extraction.op1_html_extraction,
    "op2_sharding": sharding.op2_sharding,
    "op3_packing": packing.op3_packing,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_language_id": language.op7_language_id,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_simhash": simhash.op9_simhash,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_importance_resampling": resampling.op11_importance_resampling,
    "op12_merkle_manifest": manifest.op12_merkle_manifest,
    "op13_minhash": minhash.op13_minhash,
}

ORACLES = {
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op8_decontamination": decontamination.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op11_importance_resampling": resampling.ORACLE,
    "op12_merkle_manifest": manifest.ORACLE,
}
