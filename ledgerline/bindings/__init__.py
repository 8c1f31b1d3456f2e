"""Bindings: the operators run on the given tables, next to their SQL twins."""

from __future__ import annotations

import importlib

_SECTIONS = ("q_keys", "q_filters", "q_joins", "q_rollups", "q_ranking", "q_state", "q_streams", "q_plans")


def _load():
    importlib.import_module("ledgerline.bindings.derived")
    for name in _SECTIONS:
        importlib.import_module(f"ledgerline.bindings.{name}")
    return importlib.import_module("ledgerline.bindings.registry")


def queries():
    return dict(_load().QUERIES)


def oracle_sql():
    return dict(_load().ORACLES)
