"""Imports every family of queries so that the catalogue is complete."""

from importlib import import_module

from strataline.plans.registry import CATALOG

FAMILIES = [
    "sources",
    "zones",
    "gaps",
    "windows",
    "geometry",
    "align",
    "layers",
    "spatial",
    "datum",
    "smooth",
    "evaluate",
    "blend",
    "models",
    "overlap",
    "audit",
    "profile",
    "text",
    "features",
    "flagship",
]

for family in FAMILIES:
    import_module(f"strataline.plans.{family}")

__all__ = ["CATALOG"]
