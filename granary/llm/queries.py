"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "chat_format",
    "quality_rules",
    "personal_data",
    "source_mix",
    "warc",
    "decontaminate",
    "license_scan",
    "ngram_join",
    "substring_dedup",
    "token_blocks",
    "byte_bpe",
    "hard_negatives",
    "token_alignment",
)

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _name in MODULES:
    _module = import_module(f"granary.llm.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.ORACLE_SQL)
