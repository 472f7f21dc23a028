"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib

#: Query name and module, by the operator's number.
QUERIES = {
    "op1_feistel_pseudonyms": "pii",
    "op2_stable_projections": "neighbours",
    "op3_line_dedup": "line_dedup",
    "op4_robust_outliers": "quality_rules",
    "op5_best_fit_packing": "packing",
    "op6_html_extraction": "html_extract",
    "op7_bpe": "bpe",
    "op8_simhash": "simhash",
    "op9_rule_ensemble": "rule_classifier",
    "op10_warc": "warc",
    "op11_hard_negatives": "hard_negatives",
    "op12_spelling_variants": "spelling",
    "op13_substring_dedup": "substring_dedup",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from .hard_negatives import OP11_SQL
    from .line_dedup import OP3_SQL
    from .spelling import OP12_SQL
    from .substring_dedup import OP13_SQL

    return {"op3_line_dedup": OP3_SQL, "op11_hard_negatives": OP11_SQL, "op12_spelling_variants": OP12_SQL, "op13_substring_dedup": OP13_SQL}
