"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from offerloom.llm import exact_dedup, fill_middle, language_id, license_scan, mixing, near_dedup, packing, periodic_runs, quality_classifier, quality_rules, token_counts, toxicity, transducer

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_minhash_near_dedup": near_dedup.op2_minhash_near_dedup,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_language_id": language_id.op5_language_id,
    "op6_quality_classifier": quality_classifier.op6_quality_classifier,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_packing": packing.op8_packing,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_mixing": mixing.op10_mixing,
    "op11_fill_middle": fill_middle.op11_fill_middle,
    "op12_bpe_transducer": transducer.op12_bpe_transducer,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}

ORACLES = license_scan.ORACLES | near_dedup.ORACLES | exact_dedup.ORACLES | mixing.ORACLES | fill_middle.ORACLES
