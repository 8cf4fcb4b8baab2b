"""Queries and reference SQL of this package's operators."""

from __future__ import annotations

import importlib
import pkgutil

import hoplite.llm


def _modules():
    for m in sorted(x.name for x in pkgutil.iter_modules(hoplite.llm.__path__)):
        if m != "registry":
            yield importlib.import_module(f"hoplite.llm.{m}")


def queries() -> dict:
    found: dict = {}
    for m in _modules():
        found |= getattr(m, "QUERIES", {})
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracles() -> dict[str, str]:
    found: dict = {}
    for m in _modules():
        found |= getattr(m, "ORACLES", {})
    return found
