"""The text operators' queries and their SQL."""

from __future__ import annotations

from . import decontaminate, fim, fingerprints, licenses, line_dedup, lm_scores, near_dups, ngram_join, packing, prefix_trie, substrings, toxicity, url_filters

_MODULES = (near_dups, url_filters, line_dedup, substrings, packing, decontaminate, toxicity, fingerprints, lm_scores, licenses, ngram_join, prefix_trie, fim)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
