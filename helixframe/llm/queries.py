"""The subpackage's queries and their SQL, for registration."""

from __future__ import annotations

from . import byte_bpe, fingerprints, hilbert_shards, importance_resampling, merkle_manifest, mixing, packing, pii, quality_rules, recurrent_lm, simhash_dedup, toxicity, url_templates

_ALL = {
    "op1_fingerprints": fingerprints,
    "op2_url_templates": url_templates,
    "op3_pii": pii,
    "op4_simhash_dedup": simhash_dedup,
    "op5_quality_rules": quality_rules,
    "op6_toxicity": toxicity,
    "op7_mixing": mixing,
    "op8_packing": packing,
    "op9_recurrent_lm": recurrent_lm,
    "op10_hilbert_shards": hilbert_shards,
    "op11_byte_bpe": byte_bpe,
    "op12_merkle_manifest": merkle_manifest,
    "op13_importance_resampling": importance_resampling,
}

QUERIES = {name: module.query for name, module in _ALL.items()}
ORACLES = {name: sql for name, module in _ALL.items() if (sql := getattr(module, "ORACLE_SQL", None))}
