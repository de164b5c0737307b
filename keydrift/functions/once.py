"""Keep large column expressions instead of building them call by call for every query."""

from __future__ import annotations

from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import Column, SparkSession

_kept: WeakKeyDictionary = WeakKeyDictionary()


def built_once(name: str, build: Callable[[], Column]) -> Column:
    """The column ``build`` makes, built once per session; ``name`` must identify it fully."""
    columns = _kept.setdefault(SparkSession.active(), {})
    if name not in columns:
        columns[name] = build()
    return columns[name]
