"""Query registry: one Spark plan per key and, where SQL can say it, one oracle statement."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixframe.plans.fixtures import ORACLE_VIEWS, Fixtures

_PLANS: dict[str, Callable[[Fixtures], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan; ``sql`` may use every view of ``ORACLE_VIEWS`` by name."""

    def register(plan: Callable[[Fixtures], DataFrame]):
        if name in _PLANS:
            raise ValueError(f"query {name!r} registered twice")
        _PLANS[name] = plan
        if sql is not None:
            _ORACLES[name] = sql
        return plan

    return register


def view(name: str, sql: str) -> None:
    """Add a named intermediate that oracle statements may build on."""
    if ORACLE_VIEWS.get(name, sql) != sql:
        raise ValueError(f"view {name!r} stated twice")
    ORACLE_VIEWS[name] = sql


def r6(expression: str) -> str:
    """Six decimals, with negative zero folded into zero."""
    return f"(round({expression}, 6) + 0.0)"


def plans() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(plan):
        # Every call derives its tables anew, so it sees the data as they are and pays for all it uses.
        return lambda spark, sf_dir: plan(Fixtures(spark, sf_dir))

    return {name: bind(plan) for name, plan in _PLANS.items()}


def oracles() -> dict[str, str]:
    return {name: _with_views(sql) for name, sql in _ORACLES.items()}


def _with_views(sql: str) -> str:
    ordered: list[str] = []

    def need(text: str) -> None:
        for word in re.findall(r"[A-Za-z_][A-Za-z_0-9]*", text):
            if word in ORACLE_VIEWS and word not in ordered:
                body = ORACLE_VIEWS[word]
                need(body)
                if word not in ordered:
                    ordered.append(word)

    need(sql)
    if not ordered:
        return sql
    head = ",\n".join(f"{name} AS MATERIALIZED ({ORACLE_VIEWS[name]})" for name in ordered)
    body = sql.strip()
    if re.match(r"(?i)with\s+recursive\s", body):
        return f"WITH RECURSIVE {head},\n{re.sub(r'(?i)^with\s+recursive\s+', '', body)}"
    if re.match(r"(?i)with\s", body):
        return f"WITH {head},\n{re.sub(r'(?i)^with\s+', '', body)}"
    return f"WITH {head}\n{body}"
