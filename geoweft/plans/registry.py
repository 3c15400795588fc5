"""The engine's queries by name."""

from __future__ import annotations

from . import reference_queries, training_queries

FLAGSHIP = "spatial_label_propagation"
MODULES = (training_queries, reference_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def sql() -> dict:
    return {name: text for m in MODULES for name, text in m.SQL.items()}
