"""Counts of a catalog kept up to date: signed differences of a change set instead of a recount."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from keydrift.operators.changes import apply_changes, with_own_ids


def tally(catalog: DataFrame, facet: str) -> DataFrame:
    """``facet_value, n_rows`` of every value, NULL and the empty one included; their sum is the row count."""
    return catalog.groupBy(F.col(facet).alias("facet_value")).agg(F.count("*").alias("n_rows"))


def tally_changes(snapshot: DataFrame, changes: DataFrame, fields: tuple[str, ...], facet: str) -> DataFrame:
    """``facet_value, n_rows``: by how much a change set moves each value's count; values it leaves alone are absent.

    Only rows that the changes name are taken from the snapshot: each counts -1 under its old value, and what the
    changes make of it +1 under the new one. Both sides combine before the shuffle, so a value that a third of the
    rows have is a sum of few partial sums.
    """
    changes = with_own_ids(changes, fields)
    named = changes.where("id IS NOT NULL").select("id").distinct()
    before = snapshot.join(named, "id", "left_semi")
    after = apply_changes(before, changes, fields)
    moved = before.select(F.col(facet).alias("facet_value"), F.lit(-1).alias("n")).unionByName(
        after.select(F.col(facet).alias("facet_value"), F.lit(1).alias("n"))
    )
    return _summed(moved.withColumnRenamed("n", "n_rows"))


def updated_tally(counts: DataFrame, differences: DataFrame) -> DataFrame:
    """Stored counts after differences of one or more change sets; a value without rows disappears."""
    return _summed(counts.unionByName(differences))


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("facet_value").agg(F.sum("n_rows").alias("n_rows")).where("n_rows <> 0")


def listed_values(counts: DataFrame) -> DataFrame:
    """The facet's distinct non-empty values, ascending, from the counts alone."""
    return counts.where("facet_value <> ''").select("facet_value").orderBy("facet_value")
