"""Registered queries: importing this package fills the registry."""

from importlib import import_module

from corroborate.plans.registry import REGISTRY

MODULES = ["grounding", "text", "entity", "evidence", "analytics", "matrix", "quality", "flows"]

for _name in MODULES:
    import_module(f"corroborate.plans.{_name}")

__all__ = ["REGISTRY"]
