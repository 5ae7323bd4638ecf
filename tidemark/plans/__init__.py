"""Queries that bind the operators to tables."""

from __future__ import annotations

import importlib

AREAS = ("cleaning", "schedule", "features", "labels", "splits", "quality", "metrics", "streams")


def load():
    """The registry with all queries."""
    for area in AREAS:
        importlib.import_module(f"{__name__}.{area}")
    return importlib.import_module(f"{__name__}.registry")
