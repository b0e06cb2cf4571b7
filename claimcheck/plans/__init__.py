"""Composed card model, check suite and the driver's query registry."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    """Import every query module so that it registers itself."""
    for mod in pkgutil.iter_modules(__path__):
        if mod.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{mod.name}")
