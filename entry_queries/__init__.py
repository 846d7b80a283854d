"""Registered queries by topic."""

from __future__ import annotations

import importlib

TOPICS = ["quality", "features", "sequences", "evaluation", "streams", "monitoring"]


def load() -> tuple[dict, dict]:
    """All queries and all SQL checks."""
    from . import base

    for topic in TOPICS:
        importlib.import_module(f".{topic}", __name__)
    return dict(base.QUERIES), dict(base.ORACLE)
