"""The query modules of this subpackage."""

from __future__ import annotations

import importlib
from types import ModuleType

NAMES = ("chunks", "mixture", "languages", "canonical", "overlaps", "packing", "leaks", "subjects")


def modules() -> list[ModuleType]:
    return [importlib.import_module(f"utterframe.llm.{name}") for name in NAMES]
