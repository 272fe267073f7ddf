"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

#: query -> module of this subpackage that holds a function of its name
WHERE = {
    "op1_projection_forest": "ann",
    "op2_telephony_audio": "telephony",
    "op3_sentence_rules": "licenses",
    "op4_ranked_varint_ids": "idstream",
    "op5_tree_bpe": "bytebpe",
    "op6_subsequence_svm": "toxicity",
    "op7_skip_chain_crf": "pii",
    "op8_weighted_minhash": "neardup",
    "op9_pattern_packing": "packing",
    "op10_minimax_shards": "sharding",
    "op11_fp_search": "lexical",
    "op12_fm_spelling": "spelling",
    "op13_streaming_dedup": "exactdedup",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in WHERE.items()}


def oracle_sql() -> dict[str, str]:
    from . import exactdedup, lexical, licenses, spelling

    return {"op3_sentence_rules": licenses.oracle_sql(), "op11_fp_search": lexical.oracle_sql(), "op12_fm_spelling": spelling.oracle_sql(), "op13_streaming_dedup": exactdedup.oracle_sql()}
