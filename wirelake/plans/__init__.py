"""Registered queries: every plan module adds its keys to the registry on import."""

from __future__ import annotations

import importlib
import pkgutil

from wirelake.plans.registry import REGISTRY


def load_all():
    """Import each plan module once and return the registry."""
    for module in pkgutil.iter_modules(__path__):
        if module.name not in {"registry", "tables"}:
            importlib.import_module(f"{__name__}.{module.name}")
    return REGISTRY
