"""All queries of the library outside the training-data operators."""

from __future__ import annotations

import importlib

#: Modules of this package with QUERIES and ORACLES.
MODULES = ["selection", "checks", "evaluation", "sequences", "records", "columns", "traits", "audits", "datasets"]


def _all(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{module}"), name)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracles() -> dict:
    return _all("ORACLES")
