"""Queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from . import codes, covertree, decontaminate, fim, language, licences, mixing, quality, secrets, simhash, tokens, toxicity, warc

ORACLES: dict[str, str] = {
    "op5_embedding_near_dedup": covertree.ORACLE,
    "op7_warc": warc.ORACLE,
    "op8_benchmark_decontamination": decontaminate.ORACLE,
    "op10_mixing": mixing.oracle(),
    "op11_vector_codes": codes.oracle(),
    "op12_fill_in_middle": fim.ORACLE,
}


def queries() -> dict:
    ops = [
        simhash.op1_simhash_near_dedup,
        toxicity.op2_toxicity,
        licences.op3_licence_scan,
        secrets.op4_secret_scan,
        covertree.op5_embedding_near_dedup,
        quality.op6_quality_classifier,
        warc.op7_warc,
        decontaminate.op8_benchmark_decontamination,
        language.op9_language_id,
        mixing.op10_mixing,
        codes.op11_vector_codes,
        fim.op12_fill_in_middle,
        tokens.op13_token_counts,
    ]
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
