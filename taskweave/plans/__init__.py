"""The registered queries: operators wired to the driver tables, with oracle SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("core", "packages", "delivered", "people", "readmodel", "files")


def load() -> dict:
    """Import every query module and return the registered queries."""
    for name in MODULES:
        import_module(f"taskweave.plans.{name}")
    from taskweave.plans.registry import QUERIES

    return QUERIES


def oracles() -> dict:
    from taskweave.plans.registry import ORACLES

    return ORACLES
