"""The change feed with keyed state: right whatever the order in which batches arrive."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType, TimestampType

from keydrift.operators.changes import actor_or_default, with_own_ids
from keydrift.functions.text import none_if_empty

STATE = "spark.sql.streaming.stateStore"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_on_disk(spark: SparkSession) -> None:
    spark.conf.set(f"{STATE}.providerClass", ROCKS)
    spark.conf.set(f"{STATE}.rocksdb.allowFAllocate", "false")


def _event_schema(fields: tuple[str, ...]) -> StructType:
    """What is remembered of an insert or an update, in the order in which equal ``seq`` are told apart."""
    texts = [StructField(name, StringType()) for name in fields]
    return StructType([StructField("seq", LongType()), StructField("at", LongType()), StructField("actor", StringType()), *texts])


def _place(event) -> tuple:
    """Order of events of one operation: by number, then content, nothing first."""
    return tuple((value is not None, value) for value in event)


class LastChanges(StatefulProcessor):
    """Per id its stored row, last delete, last update, and the inserts that a later delete could lay open.

    A delete that arrives late may remove the insert that counted and leave one after it, so inserts after the last
    delete are kept; what lies before it is forgotten. Nothing expires.
    """

    def __init__(self, fields: tuple[str, ...], names: tuple[str, ...], events: StructType, stored: StructType):
        self.fields, self.names, self.events, self.stored = fields, names, events, stored

    def init(self, handle) -> None:
        self.deleted = handle.getValueState("deleted", StructType([StructField("seq", LongType())]))
        self.updated = handle.getValueState("updated", self.events)
        self.inserts = handle.getListState("inserts", self.events)
        self.base = handle.getValueState("base", self.stored)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.base.update(tuple(initialState[name] for name in self.names))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        deleted = self.deleted.get()[0] if self.deleted.exists() else None
        updated = tuple(self.updated.get()) if self.updated.exists() else None
        inserts = {tuple(i) for i in self.inserts.get()} if self.inserts.exists() else set()
        for row in rows:
            event = tuple(row[name] for name in self.events.names)
            if row["op"] == "D":
                deleted = event[0] if deleted is None else max(deleted, event[0])
            elif row["op"] == "U":
                updated = event if updated is None else max(updated, event, key=_place)
            else:
                inserts.add(event)
        if deleted is not None:
            self.deleted.update((deleted,))
            inserts = {i for i in inserts if i[0] >= deleted}
            updated = updated if updated is not None and updated[0] >= deleted else None
        if inserts:
            self.inserts.put(sorted(inserts, key=_place))
        else:
            self.inserts.clear()
        if updated is not None:
            self.updated.update(updated)
        else:
            self.updated.clear()
        yield self._now(key[0], deleted, updated, inserts)

    def _now(self, key: str, deleted: int | None, updated: tuple | None, inserts: set) -> Row:
        stored = None
        if deleted is None and self.base.exists():
            stored = dict(zip(self.names, self.base.get(), strict=True))
        elif inserts:
            made = dict(zip(self.events.names, min(inserts, key=_place), strict=True))
            stored = {name: made.get(name) for name in self.names}
            stored |= {"create_by": made["actor"], "create_at": made["at"], "update_by": None, "update_at": made["at"]}
            if updated is not None and updated[0] < made["seq"]:
                updated = None
        if stored is not None and updated is not None:
            change = dict(zip(self.events.names, updated, strict=True))
            stored |= {name: change[name] for name in self.fields} | {"update_by": change["actor"], "update_at": change["at"]}
        values = [stored.get(name) if stored else None for name in self.names]
        return Row("id", "live", *self.names)(key, stored is not None, *values)


def _last_of_batches(fields: tuple[str, ...]):
    """Of every Arrow batch and id only the changes that can count, so that a hot id sends few rows on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            deletes: dict[str, dict] = {}
            updates: dict[str, dict] = {}
            inserts: dict[tuple, dict] = {}
            order = ["seq", "at", "actor", *fields]
            for row in batch.to_pylist():
                place, key = _place(row[name] for name in order), row["id"]
                if row["op"] == "I":
                    inserts[key, place] = row
                    continue
                last = deletes if row["op"] == "D" else updates
                if key not in last or _place(last[key][name] for name in order) < place:
                    last[key] = row
            after = [r for r in inserts.values() if r["id"] not in deletes or r["seq"] >= deletes[r["id"]]["seq"]]
            kept = [*deletes.values(), *updates.values(), *after]
            if kept:
                yield pa.RecordBatch.from_pylist(kept, batch.schema)

    return run


def keyed_rows(changes: DataFrame, base: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """The catalog row of every id that a batch of the stream ``changes`` touches: ``id, live``, columns of ``base``.

    ``live`` is false for an id without row now. After any number of batches, in whatever order their changes arrived,
    the last row of each id is what ``apply_changes`` makes of all of them together; refused changes (no ``seq``, no
    ``id``, unknown ``op``) do nothing. Needs the RocksDB state store (:func:`keyed_catalog_writer` sets it).
    """
    values = [none_if_empty(F.col(n)).alias(n) if n == "hos_use" else F.col(n) for n in fields]
    events = with_own_ids(changes, fields).where("id IS NOT NULL AND seq IS NOT NULL AND op IN ('I', 'U', 'D')")
    events = events.select("id", "op", "seq", F.unix_micros("at").alias("at"), actor_or_default(F.col("actor")).alias("actor"), *values)
    events = events.mapInArrow(_last_of_batches(fields), events.schema)
    # Times travel as microseconds: as such they mean the same in the state, in Python and in any time zone.
    names = tuple(c for c in base.columns if c != "id")
    times = {n for n in names if isinstance(base.schema[n].dataType, TimestampType)}
    base = base.select("id", *[F.unix_micros(n).alias(n) if n in times else F.col(n) for n in names])
    stored = StructType([StructField(n, base.schema[n].dataType) for n in names])
    result = StructType([StructField("id", StringType()), StructField("live", BooleanType()), *stored.fields])
    processor = LastChanges(fields, names, _event_schema(fields), stored)
    rows = events.groupBy("id").transformWithState(processor, result, "Update", "None", base.groupBy("id"))
    return rows.select("id", "live", *[F.timestamp_micros(n).alias(n) if n in times else F.col(n) for n in names])


def keyed_catalog_writer(changes: DataFrame, base: DataFrame, fields: tuple[str, ...], path: str, checkpoint: str) -> DataStreamWriter:
    """Write the rows that each micro-batch changes to a folder of its own; one that runs again replaces its folder."""
    keep_state_on_disk(changes.sparkSession)

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    rows = keyed_rows(changes, base, fields)
    return rows.writeStream.foreachBatch(store).outputMode("update").option("checkpointLocation", checkpoint)


def keyed_catalog(spark: SparkSession, base: DataFrame, path: str) -> DataFrame:
    """The catalog now: each id's row of the last batch that touched it, and rows of ``base`` that none did.

    One aggregation over the changed rows, combined before its shuffle.
    """
    result = StructType([StructField("live", BooleanType()), *base.schema.fields, StructField("batch_id", LongType())])
    told = spark.read.schema(result).parquet(path)
    last = told.groupBy("id").agg(F.max_by(F.struct("live", *[c for c in base.columns if c != "id"]), "batch_id").alias("row"))
    now = last.where("row.live").select(*[F.col("id") if c == "id" else F.col(f"row.{c}").alias(c) for c in base.columns])
    return reduce(DataFrame.unionByName, [base.join(last, "id", "left_anti"), now])
