"""All queries of the core with their SQL."""

from __future__ import annotations

import importlib

MODULES = ("data", "relational", "analytics", "sources")


def collect(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        for key, value in getattr(importlib.import_module(f"quern.plans.{name}"), what).items():
            if key in out:
                raise ValueError(f"two queries named {key}")
            out[key] = value
    return out
