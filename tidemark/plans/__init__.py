"""Registered queries, by area."""

from __future__ import annotations

import importlib

from tidemark.plans.registry import QUERIES, oracle_texts

AREAS = ["reporting", "fraud", "experiments", "intent", "pages", "filtering", "scoring", "retrieval", "graph",
         "topics", "governance", "storage", "streams"]


def _load() -> None:
    for area in AREAS:
        try:
            importlib.import_module(f"tidemark.plans.{area}")
        except ModuleNotFoundError as e:
            if e.name != f"tidemark.plans.{area}":
                raise


def queries():
    _load()
    return dict(QUERIES)


def oracles():
    _load()
    return oracle_texts()
