"""Queries over the given tables, grouped by theme."""

import importlib

MODULES = ["detection", "duplication", "scope", "activity", "lanes", "reports", "maps", "access", "streams"]


def load_modules() -> None:
    for name in MODULES:
        importlib.import_module(f"wardline.plans.{name}")
