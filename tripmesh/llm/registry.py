"""Queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from tripmesh.llm import (
    op01_decontaminate,
    op02_shards,
    op03_language,
    op04_line_dedup,
    op05_toxicity,
    op06_licenses,
    op07_near_dedup,
    op08_repeats,
    op09_fingerprint,
    op10_pack,
    op11_fill_middle,
    op12_prefix_trie,
    op13_url_filter,
)

QUERIES = {
    "op1_decontamination": op01_decontaminate.query,
    "op2_shards": op02_shards.query,
    "op3_language": op03_language.query,
    "op4_line_dedup": op04_line_dedup.query,
    "op5_toxicity": op05_toxicity.query,
    "op6_licenses": op06_licenses.query,
    "op7_near_dedup": op07_near_dedup.query,
    "op8_repeats": op08_repeats.query,
    "op9_fingerprints": op09_fingerprint.query,
    "op10_packing": op10_pack.query,
    "op11_fill_middle": op11_fill_middle.query,
    "op12_prefix_trie": op12_prefix_trie.query,
    "op13_url_filter": op13_url_filter.query,
}

ORACLE_SQL = {
    "op4_line_dedup": op04_line_dedup.SQL,
    "op6_licenses": op06_licenses.SQL,
    "op11_fill_middle": op11_fill_middle.SQL,
    "op12_prefix_trie": op12_prefix_trie.SQL,
}
