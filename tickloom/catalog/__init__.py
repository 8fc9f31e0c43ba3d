"""The named queries of every area."""

from importlib import import_module

from tickloom.catalog.core import ORACLES, QUERIES

AREAS = [
    "bars", "flow", "profile", "research", "data", "derivatives", "trades", "pairs", "intel", "params", "companies",
    "streams", "learn",
]


def load():
    for a in AREAS:
        import_module(f"tickloom.catalog.{a}")
    return QUERIES, ORACLES
