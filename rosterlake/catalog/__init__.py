"""Queries on the driver tables, grouped by subject."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["form", "relations", "summaries", "squads", "scoring", "frames", "forecasts", "stores", "streams", "landings"]


def load():
    """All registered queries by name."""
    for name in _MODULES:
        import_module(f"rosterlake.catalog.{name}")
    from rosterlake.catalog.base import REGISTRY

    return REGISTRY
