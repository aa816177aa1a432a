"""Loads every catalog module, so the registry is complete."""

from __future__ import annotations

import importlib

from risklake.plans.registry import REGISTRY

MODULES = [
    "catalog_series", "catalog_indicators", "catalog_metrics", "catalog_risk", "catalog_allocation", "catalog_simulation",
    "catalog_platform", "catalog_alerts", "catalog_telemetry",
]

for _name in MODULES:
    importlib.import_module(f"risklake.plans.{_name}")

__all__ = ["REGISTRY"]
