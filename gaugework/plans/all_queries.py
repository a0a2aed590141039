"""Imports every module that registers queries."""

from __future__ import annotations

import importlib

MODULES = (
    "cell_queries",
    "series_queries",
    "metric_queries",
    "integrity_queries",
    "eligibility_queries",
    "decision_queries",
    "publish_queries",
    "package_queries",
    "source_queries",
    "review_queries",
    "adoption_queries",
)


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"gaugework.plans.{name}")
