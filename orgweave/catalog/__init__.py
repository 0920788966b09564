"""Registered queries by operator family."""

from importlib import import_module
from pkgutil import iter_modules


def load() -> None:
    """Import every catalog module so that its queries register."""
    for module in sorted(m.name for m in iter_modules(__path__)):
        import_module(f"{__name__}.{module}")
