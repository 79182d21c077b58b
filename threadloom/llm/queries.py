"""Queries of the problems tagged llm, and their SQL where SQL can express them."""

from __future__ import annotations

from threadloom.llm.language import p1_found, p1_languages, p1_segments
from threadloom.llm.leakage import p7_found, p7_items
from threadloom.llm.mixing import p8_selection, p8_shares
from threadloom.llm.neardup import p3_classes, p3_found
from threadloom.llm.sentences import p9_found
from threadloom.llm.splits import row_splits, same_split_pairs, split_rows
from threadloom.llm.truncation import p6_found, p6_rates

QUERIES = {
    "p1_found": p1_found,
    "p1_languages": p1_languages,
    "p1_segments": p1_segments,
    "p2_found": same_split_pairs,
    "p2_splits": split_rows,
    "p2_rows": row_splits,
    "p3_found": p3_found,
    "p3_classes": p3_classes,
    "p6_found": p6_found,
    "p6_rates": p6_rates,
    "p7_found": p7_found,
    "p7_items": p7_items,
    "p8_selection": p8_selection,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
}

ORACLES: dict[str, str] = {}
