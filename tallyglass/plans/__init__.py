"""Registered queries, one module per family of the operator inventory."""

from importlib import import_module
from pkgutil import iter_modules


def load() -> None:
    """Import every module of this package, which registers its queries."""
    for module in iter_modules(__path__):
        import_module(f"{__name__}.{module.name}")
