"""Named queries and the SQL each is held against."""

from __future__ import annotations

from importlib import import_module

MODULES = ("periods", "scalars", "timing", "formats", "analysis", "wordlevel", "composite", "cases")


def collect() -> tuple[dict, dict]:
    queries, oracles = {}, {}
    for name in MODULES:
        module = import_module(f"{__name__}.{name}")
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles
