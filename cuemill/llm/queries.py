"""Queries of the problems on text, and SQL where SQL can say the same."""

from __future__ import annotations

from importlib import import_module

MODULES = ("encoding_queries", "language_queries", "runs_queries", "sentences_queries", "turns_queries", "bitext_queries", "corpus_queries")
QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = import_module(f"cuemill.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= getattr(_module, "ORACLES", {})
