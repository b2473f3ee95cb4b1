"""Queries over the test tables and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("q_detect", "q_protect", "q_policy", "q_traffic", "q_audit", "q_reports", "q_stream", "q_sources")


def all_queries():
    """``(queries, oracles)`` by name."""
    for module in MODULES:
        import_module(f"veilframe.plans.{module}")
    from veilframe.plans.catalog import ORACLES, QUERIES

    return QUERIES, ORACLES
