"""Registered queries: each operator over the given tables, with its SQL counterpart."""

from __future__ import annotations

import importlib

_MODULES = ["checks_text", "checks_structure", "checks_refs", "checks_joins", "checks_quality", "checks_answers"]


def registry() -> dict:
    """name -> (query function, SQL or None)."""
    out: dict = {}
    for name in _MODULES:
        out.update(importlib.import_module(f"{__name__}.{name}").Q)
    return out
