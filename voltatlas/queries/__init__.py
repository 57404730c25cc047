"""Queries of the driver contract. Importing a module registers its queries."""

import importlib

_MODULES = [
    "marts", "sources", "pages", "cleaning", "classify", "energy", "joins", "aggregates", "panel",
    "models",
]


def load():
    from voltatlas.queries import registry

    for name in _MODULES:
        importlib.import_module(f"voltatlas.queries.{name}")
    return registry
