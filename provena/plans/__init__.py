"""Registered queries over the driver's tables."""

from __future__ import annotations

import importlib

MODULES = ("search", "governance", "content", "tabular", "streams")


def load():
    """The registry, with every module that registers queries imported."""
    from provena.plans import registry

    for name in MODULES:
        importlib.import_module(f"provena.plans.{name}")
    return registry
