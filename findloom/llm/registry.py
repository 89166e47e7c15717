"""Queries of the training-data operators and their DuckDB counterparts."""

from findloom.llm import bpe, licenses, linededup, merkle, mixing, neardup, negatives, pii, quality, substrings, tokenfiles, urls, vectors

QUERIES = {
    "op1_token_ids": tokenfiles.op1_token_ids,
    "op2_mixing_sources": mixing.op2_mixing_sources,
    "op3_url_filters": urls.op3_url_filters,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_minhash": neardup.op5_minhash,
    "op6_bpe": bpe.op6_bpe,
    "op7_vectors": vectors.op7_vectors,
    "op8_substrings": substrings.op8_substrings,
    "op9_pii": pii.op9_pii,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_line_dedup": linededup.op13_line_dedup,
}
ORACLES = {
    "op2_mixing_sources": mixing.ORACLE,
    "op3_url_filters": urls.ORACLE,
    "op10_quality_rules": quality.ORACLE,
    "op11_hard_negatives": negatives.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
    "op13_line_dedup": linededup.ORACLE,
}
