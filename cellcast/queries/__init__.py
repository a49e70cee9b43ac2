"""Registered queries: every operator on inputs derived from the driver's tables."""

from importlib import import_module

MODULES = [
    "drought_queries",
    "source_queries",
    "grid_queries",
    "load_queries",
    "ensemble_queries",
    "assimilation_queries",
    "crop_queries",
]


def load() -> None:
    """Import every query module, which fills the registry."""
    for name in MODULES:
        import_module(f"cellcast.queries.{name}")
