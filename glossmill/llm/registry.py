"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from glossmill.llm import (
    bpe_tree,
    decontam,
    filter_audit,
    fim,
    minhash,
    packing,
    pii,
    quality,
    secret_scan,
    sharding,
    simhash,
    substring_dedup,
    warc,
)

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_packing": packing.op2_packing,
    "op3_decontam": decontam.op3_decontam,
    "op4_suffix_dedup": substring_dedup.op4_suffix_dedup,
    "op5_pii": pii.op5_pii,
    "op6_warc": warc.op6_warc,
    "op7_sharding": sharding.op7_sharding,
    "op8_secrets": secret_scan.op8_secrets,
    "op9_fingerprints": minhash.op9_fingerprints,
    "op10_simhash": simhash.op10_simhash,
    "op11_fill_in_middle": fim.op11_fill_in_middle,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_bpe_tree": bpe_tree.op13_bpe_tree,
}

ORACLES = {
    "op3_decontam": decontam.ORACLE,
    "op6_warc": warc.ORACLE,
    "op11_fill_in_middle": fim.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
}
