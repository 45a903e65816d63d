"""Queries over the supplied tables with the SQL that states their results."""

from __future__ import annotations

import importlib
import pkgutil


def load():
    """Import every query module of this folder and return ``(queries, sql)``."""
    from tidewatch.workload import registry

    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")
    return registry.QUERIES, registry.ORACLES
