"""Queries of this subpackage and the SQL that some of them are held against."""

from __future__ import annotations

from . import op1_quality_rules, op5_mixing
from .op2_classifier import op2_quality_score
from .op3_spotsigs import op3_spotsigs
from .op4_html import op4_html_blocks
from .op6_packing import op6_packing
from .op10_suffix_dedup import op10_suffix_repeats
from .op7_line_dedup import op7_fuzzy_lines
from .op8_simhash import op8_simhash_pivots
from .op9_pii import op9_pii_spans

QUERIES = {
    "op1_quality_rules": op1_quality_rules.op1_quality_rules,
    "op2_quality_score": op2_quality_score,
    "op3_spotsigs": op3_spotsigs,
    "op4_html_blocks": op4_html_blocks,
    "op5_source_mixing": op5_mixing.op5_source_mixing,
    "op6_packing": op6_packing,
    "op7_fuzzy_lines": op7_fuzzy_lines,
    "op8_simhash_pivots": op8_simhash_pivots,
    "op9_pii_spans": op9_pii_spans,
    "op10_suffix_repeats": op10_suffix_repeats,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": op1_quality_rules.ORACLE_SQL,
    "op5_source_mixing": op5_mixing.ORACLE_SQL,
}
