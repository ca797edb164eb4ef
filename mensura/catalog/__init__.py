"""Registered queries and their ANSI SQL counterparts."""

from __future__ import annotations

import importlib

_MODULES = ("identify", "functions", "analysis", "regression", "enrollment", "shapes", "stores")


def load():
    """(queries, oracle SQL) of all catalogue modules."""
    for name in _MODULES:
        importlib.import_module(f"{__name__}.{name}")
    from .base import ORACLES, QUERIES
    return dict(QUERIES), dict(ORACLES)
