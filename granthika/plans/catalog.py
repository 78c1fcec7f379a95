"""All queries of the core operators with their SQL, collected from the modules of this package."""

from __future__ import annotations

from . import q_compose, q_ingest, q_measure, q_ops, q_search, q_text

_MODULES = (q_ingest, q_text, q_search, q_measure, q_compose, q_ops)


def queries():
    return {name: fn for m in _MODULES for name, (fn, _) in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in _MODULES for name, (_, sql) in m.QUERIES.items() if sql}
