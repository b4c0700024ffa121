"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

#: Query name to the module that defines it under the same name.
MODULES = {
    "op1_embedding_near_dedup": "embedding_dedup",
    "op2_warc": "arc_convert",
    "op3_packing": "packing",
    "op4_mixing": "mixing",
    "op5_language_id": "language_id",
    "op6_exact_topk": "exact_topk",
    "op7_toxicity": "toxicity",
    "op8_simhash_near_dedup": "simhash_dedup",
    "op9_quality": "quality",
    "op10_html_extraction": "html_render",
    "op11_importance_resampling": "importance",
    "op12_pii": "pii",
    "op13_spelling_variants": "spelling",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    """Of the queries that SQL expresses at any size."""
    from . import arc_convert, exact_topk

    return {"op2_warc": arc_convert.ORACLE_SQL, "op6_exact_topk": exact_topk.ORACLE_SQL}
