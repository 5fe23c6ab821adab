"""Named image sources: each a function ``(spark, **options) -> DataFrame`` of candidates."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_sources: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    def add(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _sources[name] = make
        return make

    return add


def candidates(spark: SparkSession, name: str, **options) -> DataFrame:
    """The candidates of a registered source; unknown names and options are errors, unset options keep defaults."""
    from . import catalog  # noqa: F401  registers the catalog
    if name not in _sources:
        raise ValueError(f"unknown source {name!r}; there are {sorted(_sources)}")
    known = list(inspect.signature(_sources[name]).parameters)[1:]
    if unknown := sorted(set(options) - set(known)):
        raise ValueError(f"source {name!r} has no option {unknown[0]!r}; it has {known}")
    return _sources[name](spark, **options)
