"""Named queries over the supplied tables."""

from __future__ import annotations

import importlib
import pkgutil


def load_catalogue():
    """Import every ``q_*`` module and return (queries, sql) by name."""
    for info in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        if info.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{info.name}")
    from barwise.plans.catalogue import QUERIES, SQL
    return QUERIES, SQL
