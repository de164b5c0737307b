"""Import history: one row per imported key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from keydrift.operators.merge import imported_keys

# Kinds of an import and their labels.
SINGLE, ALL = "single", "all"
LABELS = {ALL: "Bulk", SINGLE: "Single"}


def history_rows(imported: DataFrame, kind: str, at: Column | None = None) -> DataFrame:
    """Missing or imported keys → history rows; ``batch_seq`` keeps the order inside one import.

    Rows keep the order they come in: comparing and importing are narrow, so pairs that were
    ordered beforehand need no sort of their rows.
    """
    if kind not in (SINGLE, ALL):
        raise ValueError(f"kind must be {SINGLE!r} or {ALL!r}, not {kind!r}")
    at = F.current_timestamp() if at is None else at
    return imported.select(
        "pair_id",
        at.cast("timestamp").alias("ts"),
        F.col("seq").cast("int").alias("batch_seq"),
        "path",
        "value_json",
        F.lit(kind).alias("type"),
    )


def append_history(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def import_history(merged: DataFrame, kind: str, at: Column | None = None) -> DataFrame:
    """History of exactly the keys that an import (``import_all``, ``import_selected``) took over."""
    return history_rows(imported_keys(merged), kind, at)


def newest_history_first(history: DataFrame) -> DataFrame:
    """Stored history; for new rows order the pairs before they are walked."""
    return history.orderBy(F.col("ts").desc_nulls_first(), "pair_id", "batch_seq")


def with_label(history: DataFrame) -> DataFrame:
    return history.withColumn("label", F.when(F.col("type") == ALL, LABELS[ALL]).otherwise(LABELS[SINGLE]))


def without_pairs(history: DataFrame, cleared: DataFrame) -> DataFrame:
    """History after the pairs in ``cleared`` were emptied."""
    return history.join(cleared.select("pair_id").distinct(), "pair_id", "left_anti")
