"""Joining a large frame to a lookup that has one row per key, whatever the key's skew."""

from __future__ import annotations

from pyspark.sql import DataFrame


def look_up(large: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Left join of ``large`` to ``lookup``, which must have one row per ``key``.

    Building it runs no job. At run time adaptive execution knows the lookup's size: a small one is
    broadcast under the session's threshold; otherwise both sides are shuffled, and the partitions of
    hot keys (and of rows without a key) are split, which a left join allows for its large side.
    """
    return large.join(lookup, key, "left")
