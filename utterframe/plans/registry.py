"""The query modules of the core."""

from __future__ import annotations

import importlib
from types import ModuleType

NAMES = ("interval_queries", "metric_queries", "relational_queries", "window_queries", "sequence_queries", "speech_queries", "extension_queries", "stream_queries", "record_queries")


def modules() -> list[ModuleType]:
    return [importlib.import_module(f"utterframe.plans.{name}") for name in NAMES]
