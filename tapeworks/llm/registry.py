"""The subpackage's queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

import importlib

#: Query name: module that has a function of that name, and SQL under the name in the third place.
TABLE = {
    "op10_minhash_dedup": ("minhash_dedup", "SQL"),
    "op3_sentencepiece": ("piece_codec", None),
    "op4_language_id": ("language_id", None),
    "op5_mixing": ("mixing", "SQL"),
    "op6_sharding": ("sharding", None),
    "op2_topk_search": ("mtree", "SQL"),
    "op7_quality": ("weak_labels", None),
    "op8_html_extraction": ("html_extract", None),
    "op9_nearest": ("hilbert", None),
    "op1_substring_dedup": ("substring_dedup", "SQL"),
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"tapeworks.llm.{module}"), name) for name, (module, _) in TABLE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: getattr(importlib.import_module(f"tapeworks.llm.{module}"), sql) for name, (module, sql) in TABLE.items() if sql}
