"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import best_fit, html_text, mixing, neardup, neighbours, packing, periodic_runs, pitman_yor, quality, secret_ledger, spelling, substring_dedup, toxicity

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_html_text": html_text.op3_html_text,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_near_duplicates": neardup.op5_near_duplicates,
    "op6_mixing": mixing.op6_mixing,
    "op7_quality": quality.op7_quality,
    "op8_lm_scores": pitman_yor.op8_lm_scores,
    "op9_neighbours": neighbours.op9_neighbours,
    "op10_secrets": secret_ledger.op10_secrets,
    "op11_best_fit": best_fit.op11_best_fit,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_spelling": spelling.op13_spelling,
}
SQL = {
    "op4_substring_dedup": substring_dedup.SQL,
    "op5_near_duplicates": neardup.SQL,
    "op6_mixing": mixing.SQL,
    "op7_quality": quality.SQL,
    "op10_secrets": secret_ledger.SQL,
    "op13_spelling": spelling.SQL,
}
