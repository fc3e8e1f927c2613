"""Registered queries over the test tables, one module per operator family."""

import importlib
import pkgutil


def load_all():
    """Import every catalog module and return the registry."""
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")
    return importlib.import_module(f"{__name__}.registry")
