"""Rule tables: fixed values, their DataFrame form and a loader for rule documents."""

from attesta.registry.tables import Registry, default_registry

__all__ = ["Registry", "default_registry"]
