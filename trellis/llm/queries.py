"""The queries of this subpackage, for registration, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib
import sys
from pathlib import Path

_OPS = {
    "op1_host_reputation": ("host_reputation", "op1"), "op2_pii_weak_supervision": ("pii", "op2"), "op3_toxicity_grammar": ("toxicity", "op3"), "op4_katz_backoff": ("katz", "op4"), "op5_sentencepiece_scan": ("pieces", "op5"),
    "op6_best_fit_packing": ("packing", "op6"), "op7_phrase_automata": ("phrase_automata", "op7"), "op8_simhash_variants": ("simhash_variants", "op8"), "op9_matroska": ("matroska", "op9"), "op10_spotsigs": ("spotsigs", "op10"),
}


def _pipeline(spark, sf_dir):
    top = str(Path(__file__).resolve().parents[2])
    if top not in sys.path:
        sys.path.insert(0, top)
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


def _query(module: str, function: str):
    return lambda spark, sf_dir: getattr(importlib.import_module(f"{__package__}.{module}"), function)(spark, sf_dir)


def queries() -> dict:
    return {name: _query(*at) for name, at in _OPS.items()} | {"pipeline": _pipeline}


def oracle_sql() -> dict[str, str]:
    from .host_reputation import ORACLE_SQL

    return {"op1_host_reputation": ORACLE_SQL}
