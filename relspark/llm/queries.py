"""The registered queries of this subpackage and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from importlib import import_module

from .decontam import DECONTAM_SQL
from .warc import WARC_SQL

_QUERIES = {
    "op1_near_duplicates": ("neardup", "near_dup_query"),
    "op2_warc": ("warc", "warc_query"),
    "op3_lm_score": ("lmscore", "lm_query"),
    "op4_packing": ("packing", "packing_query"),
    "op5_nearest": ("ann", "ann_query"),
    "op6_language_id": ("langid", "langid_query"),
    "op7_tool_calls": ("chat", "chat_query"),
    "op8_decontamination": ("decontam", "decontam_query"),
    "op9_toxicity": ("toxicity", "toxicity_query"),
    "op10_license_scan": ("license_scan", "license_query"),
}

ORACLES: dict[str, str] = {"op2_warc": WARC_SQL, "op8_decontamination": DECONTAM_SQL}


def _bind(module: str, name: str):
    return getattr(import_module(f"{__package__}.{module}"), name)


def queries() -> dict:
    return {key: _bind(*at) for key, at in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
