"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from importlib import import_module

_NAMES = {
    "op1_suffix_dedup": "suffix_dedup",
    "op10_minhash_dedup": "minhash_dedup",
    "op2_warc": "warc",
    "op4_topk_search": "topk_search",
    "op5_sharding": "sharding",
    "op7_packing": "packing",
    "op9_byte_bpe": "byte_bpe",
    "op3_language_id": "language_id",
    "op6_embedding_dedup": "embedding_dedup",
    "op8_line_dedup": "line_dedup",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _NAMES.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, module in _NAMES.items():
        if sql := getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None):
            out[name] = sql
    return out
