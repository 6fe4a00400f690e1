"""Named queries over the driver's tables, grouped like the operators."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> None:
    """Import every query module so that it registers its queries."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
