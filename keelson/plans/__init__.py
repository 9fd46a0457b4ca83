"""Registered queries, grouped as in the operator inventory."""

from importlib import import_module

MODULES = ("scans", "scalars", "predicates", "retrieval", "fusion", "joins", "aggregates", "graph", "streams", "extensions")


def load() -> None:
    for module in MODULES:
        import_module(f"keelson.plans.{module}")
