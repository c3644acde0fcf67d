"""The registered queries, by area."""

from __future__ import annotations

import importlib

AREAS = ["protection", "validation", "access", "tables", "audit", "metrics", "streams"]


def entries() -> dict:
    found = {}
    for area in AREAS:
        found.update(importlib.import_module(f"cloakframe.catalog.{area}").ENTRIES)
    return found
