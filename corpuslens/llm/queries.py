"""The queries of this subpackage, and DuckDB SQL for those that it can express."""

from __future__ import annotations

from . import ann, exact_search, language_id, license_scan, line_dedup, mixing, packing, quality, simhash, substring_dedup

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_packing": packing.op2_packing,
    "op3_simhash": simhash.op3_simhash,
    "op4_mixing": mixing.op4_mixing,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_quality": quality.op6_quality,
    "op7_language_id": language_id.op7_language_id,
    "op8_exact_search": exact_search.op8_exact_search,
    "op9_ann": ann.op9_ann,
    "op10_license_scan": license_scan.op10_license_scan,
}

ORACLES = {
    "op1_line_dedup": line_dedup.SQL.format(docs="documents"),
    "op4_mixing": mixing.SQL,
    "op5_substring_dedup": substring_dedup.SQL,
    "op8_exact_search": exact_search.SQL,
}
