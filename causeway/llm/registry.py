"""Queries of the subpackage and their DuckDB SQL; importing the operator modules fills both."""

from __future__ import annotations

from importlib import import_module

from causeway.llm.common import QUERIES, SQL

MODULES = ("url_filters", "toxicity", "ngram_join", "secret_scan", "vector_dedup", "chat_format", "quality_rules", "source_mix",
           "packing", "suffix_dedup", "importance_resampling", "piece_codec",
           "hard_negatives")
for _m in MODULES:
    import_module(f"causeway.llm.{_m}")

__all__ = ["QUERIES", "SQL"]
