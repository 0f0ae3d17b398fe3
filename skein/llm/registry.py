"""The queries of this subpackage and, where SQL can say the same, their twins."""

from __future__ import annotations

import corpus_pipeline

from . import byte_bpe, fingerprints, licenses, lm_score, mixing, near_dedup, personal_data, quality_rules, secrets, url_filter

MODULES = {
    "op1_quality_rules": quality_rules,
    "op2_fingerprints": fingerprints,
    "op3_mixing": mixing,
    "op4_near_dedup": near_dedup,
    "op5_byte_bpe": byte_bpe,
    "op6_secrets": secrets,
    "op7_url_filter": url_filter,
    "op8_licenses": licenses,
    "op9_personal_data": personal_data,
    "op10_lm_score": lm_score,
}


def queries() -> dict:
    return {**{k: m.query for k, m in MODULES.items()}, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    out = {k: m.sql() for k, m in MODULES.items() if hasattr(m, "sql")}
    if corpus_pipeline.ORACLE_SQL:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
