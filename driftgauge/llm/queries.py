"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

#: Query name -> module that holds a function of that name.
MODULES = {
    "op1_jaccard": "jaccard",
    "op2_bpe": "bpe",
    "op3_embeddings": "embeddings",
    "op4_toxicity": "toxicity",
    "op5_secrets": "secrets",
    "op6_packing": "packing",
    "op7_media": "media",
    "op8_mixing": "mixing",
    "op9_scoring": "scoring",
    "op10_substring": "substring",
    "op11_sharding": "sharding",
    "op12_spelling": "spelling",
    "op13_negatives": "negatives",
}


def query(name: str):
    """The query, from its module; ImportError where that needs what is not there."""
    return getattr(importlib.import_module(f"driftgauge.llm.{MODULES[name]}"), name)


def sql(name: str) -> str | None:
    return getattr(importlib.import_module(f"driftgauge.llm.{MODULES[name]}"), "ORACLE_SQL", None)


def queries() -> dict:
    return {name: query(name) for name in MODULES}


def oracle_sql() -> dict[str, str]:
    return {name: text for name in MODULES if (text := sql(name))}
