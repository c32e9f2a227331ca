"""Registered queries; importing a module adds its entries."""

from importlib import import_module

MODULES = ("features", "scalars", "splits", "prep", "metrics", "tables", "fields", "learners", "codes", "reports", "study")


def load() -> None:
    for name in MODULES:
        import_module(f".{name}", __name__)
