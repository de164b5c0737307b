"""A stored import history that is cleared by marks: a clear adds a row instead of rewriting the table.

A store is a folder with ``rows`` (history) and ``clears`` (pair and time), both in shelves by a hash of the pair. A
pair's rows up to its last clear are out of sight at once; :func:`compact` takes them out of the shelves that were
cleared and leaves the others as they are. One writer at a time; a step that is run again does no harm. The number of
shelves is chosen when a store is begun and stays.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructType

from keydrift.sources.schemas import HISTORY
from keydrift.sources.shared import stored

_CLEARS = "pair_id bigint, cleared_at timestamp, folded boolean, shelf int"


@dataclass(frozen=True)
class HistoryStore:
    path: str
    shelves: int = 64

    def shelf(self) -> Column:
        return F.pmod(F.xxhash64("pair_id"), F.lit(self.shelves)).cast("int").alias("shelf")

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(StructType([*HISTORY.fields]).add("shelf", IntegerType())).parquet(f"{self.path}/rows")

    def clears(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_CLEARS).parquet(f"{self.path}/clears")


def begin_history(spark: SparkSession, store: HistoryStore) -> None:
    """An empty store; one that is there already is left as it is."""
    for name, schema in (("rows", StructType([*HISTORY.fields]).add("shelf", IntegerType())), ("clears", _CLEARS)):
        spark.createDataFrame([], schema).write.mode("append").partitionBy("shelf").parquet(f"{store.path}/{name}")


def append_rows(rows: DataFrame, store: HistoryStore) -> None:
    """Add history rows. Ranges that end in time and place split a pair that holds much of the history."""
    rows = rows.select(*HISTORY.fieldNames(), store.shelf()).repartitionByRange("shelf", "pair_id", "ts", "batch_seq")
    rows.write.mode("append").partitionBy("shelf").parquet(f"{store.path}/rows")


def clear_pairs(pairs: DataFrame, store: HistoryStore, at: Column | None = None) -> None:
    """Empty the history of the pairs in ``pairs`` up to ``at`` (now); nothing that is stored is read."""
    at = F.current_timestamp() if at is None else at
    marks = pairs.where("pair_id IS NOT NULL").select(F.col("pair_id").cast("bigint")).distinct()
    marks = marks.select("pair_id", at.cast("timestamp").alias("cleared_at"), F.lit(False).alias("folded"), store.shelf())
    marks.write.mode("append").partitionBy("shelf").parquet(f"{store.path}/clears")


def _in_sight(spark: SparkSession, store: HistoryStore) -> DataFrame:
    last = store.clears(spark).groupBy("shelf", "pair_id").agg(F.max("cleared_at").alias("cleared_at"))
    rows = store.rows(spark).join(last, ["shelf", "pair_id"], "left")
    return rows.where("cleared_at IS NULL OR ts > cleared_at").select(*HISTORY.fieldNames(), "shelf")


def current_history(spark: SparkSession, store: HistoryStore) -> DataFrame:
    """History rows later than their pair's last clear; a row without time counts as earlier than any."""
    return _in_sight(spark, store).select(*HISTORY.fieldNames())


def compact(spark: SparkSession, store: HistoryStore) -> list[int]:
    """Take cleared rows out of the shelves that were cleared since the last time, and tell which these are.

    A pair's clears become one mark, which stays, so that rows arriving late with an earlier time stay out of sight. A
    shelf that would have no rows left keeps its files until it gets some; its marks hide them.
    """
    fresh = store.clears(spark).where("NOT folded").select("shelf").distinct()
    shelves = sorted(r.shelf for r in fresh.collect())  # at most as many as the store has
    if not shelves:
        return []
    touched = F.col("shelf").isin(*shelves)
    # Written aside first: the shelves are read before they are replaced, and replaced again if that is cut short.
    rows = stored(_in_sight(spark, store).where(touched), "history")
    marks = store.clears(spark).where(touched).groupBy("pair_id", "shelf").agg(F.max("cleared_at").alias("cleared_at"))
    marks = stored(marks.select("pair_id", "cleared_at", F.lit(True).alias("folded"), "shelf"), "clears")
    for table, name in ((rows.repartitionByRange("shelf", "pair_id", "ts", "batch_seq"), "rows"), (marks.repartition("shelf"), "clears")):
        writer = table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shelf")
        writer.parquet(f"{store.path}/{name}")
    return shelves
