"""Queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from retentio.llm import chat, chosen_path, main_text, mixing, packed_negatives, positions, prefix_trie, quality, secret_scan, suffix_dedup, tokens, toxicity, warc

MODULES = (suffix_dedup, main_text, chosen_path, toxicity, positions, warc, quality, secret_scan, mixing, tokens, packed_negatives, chat, prefix_trie)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
