"""Registered queries: each operator applied to the driver tables, with its checking SQL."""

from __future__ import annotations

import importlib

SECTIONS = ("sources", "constraints", "items", "geometry", "masks", "joins", "relations", "reports", "windows", "sampling", "stats", "text", "sets", "decisions")


def _load() -> None:
    for s in SECTIONS:
        importlib.import_module(f"plumbline.plans.{s}")


def all_queries():
    from plumbline.plans.registry import QUERIES

    _load()
    return dict(QUERIES)


def all_oracles():
    from plumbline.plans.registry import ORACLES

    _load()
    return dict(ORACLES)
