"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import decontamination, langid, lexical, merkle, mixing, pii, quality, simhash, substring_dedup, suffix_dedup, token_output, toxicity, vector_search


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_mix": mixing.op2_mix,
        "op3_wavelet_tokens": token_output.op3_wavelet_tokens,
        "op4_topk": vector_search.op4_topk,
        "op5_suffixes": suffix_dedup.op5_suffixes,
        "op6_simhash": simhash.op6_simhash,
        "op7_decontamination": decontamination.op7_decontamination,
        "op8_substrings": substring_dedup.op8_substrings,
        "op9_pii": pii.op9_pii,
        "op10_langid": langid.op10_langid,
        "op11_merkle": merkle.op11_merkle,
        "op12_quality": quality.op12_quality,
        "op13_lexical": lexical.op13_lexical,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_topk": vector_search.ORACLE, "op8_substrings": substring_dedup.ORACLE, "op11_merkle": merkle.ORACLE, "op13_lexical": lexical.ORACLE}
