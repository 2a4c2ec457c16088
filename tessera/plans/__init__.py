"""Queries by name, one module per kind of operator."""

from __future__ import annotations

import importlib
import pkgutil


def loaded():
    """The registry, with every module of this package loaded."""
    from tessera.plans import registry

    for m in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        importlib.import_module(f"{__name__}.{m.name}")
    return registry
