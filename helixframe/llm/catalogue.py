"""Registered queries of this subpackage and their oracle statements."""

from __future__ import annotations

import importlib
import pkgutil

import helixframe.llm as package
from helixframe.llm.common import registered

for _module in sorted(m.name for m in pkgutil.iter_modules(package.__path__)):
    if _module not in {"catalogue", "common"}:
        importlib.import_module(f"{package.__name__}.{_module}")


def queries():
    return registered()[0]


def oracle_sql():
    return registered()[1]
