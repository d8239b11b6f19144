"""Collects every plan module into the registered queries."""

from __future__ import annotations

import importlib
import pkgutil

import helixframe.plans as package
from helixframe.plans.registry import oracles, plans

_SUPPORT = {"catalogue", "fixtures", "registry"}

for _module in sorted(m.name for m in pkgutil.iter_modules(package.__path__)):
    if _module not in _SUPPORT:
        importlib.import_module(f"{package.__name__}.{_module}")


def queries():
    return plans()


def oracle_sql():
    return oracles()
