"""Exact deduplication by streaming state (operator 10).

Arriving documents are appended to a content store, each row with a locator. A stream over the store keeps
one state row per digest, in RocksDB and without expiry: the digest, the stable identifier and locator of
the row that stays, and a count. Later arrivals go on from the same state: `ingest` again, then `advance`.
`resolve` compares the full bytes of every hit with the row that stays; texts that only share the digest
form groups of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keydrift.llm.common import if_small, saved, shared_folder

STATE = "spark.sql.streaming.stateStore"
#: State on disk, with a bound on its memory in an executor; files take no space before they are written.
ON_DISK = {
    f"{STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{STATE}.rocksdb.allowFAllocate": "false",
    f"{STATE}.rocksdb.boundedMemoryUsage": "true",
    f"{STATE}.rocksdb.maxMemoryUsageMB": "128",
    f"{STATE}.rocksdb.writeBufferSizeMB": "4",
}


def normalised(text: Column) -> Column:
    """Runs of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _order() -> Column:
    """The smallest is the row that stays: null ids come last, repeated ids go by locator."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "arrival", "locator")


class Deduplicator:
    """Content store and keyed state below one folder; both survive restarts, so batches can follow."""

    def __init__(self, spark: SparkSession, root: str, digest: Callable[[Column], Column] = sha256):
        self.spark, self.root, self.digest = spark, root, digest

    def ingest(self, docs: DataFrame) -> None:
        """Append doc_id, normalised text, digest and locator (arrival, row) of every row, once."""
        text = docs.select("doc_id", normalised(F.col("text")).alias("content"))
        rows = text.select(
            "doc_id",
            "content",
            self.digest(F.col("content")).alias("digest"),
            F.lit(self._arrivals()).alias("arrival"),
            F.monotonically_increasing_id().alias("locator"),
        )
        rows.write.mode("append").parquet(f"{self.root}/content")

    def _arrivals(self) -> int:
        try:
            return self.content().agg(F.max("arrival")).first()[0] + 1
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return 0

    def content(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/content")

    def advance(self) -> None:
        """Take what arrived since the last call into the state; write the changed state rows per batch."""
        schema = self.content().schema
        rows = self.spark.readStream.schema(schema).parquet(f"{self.root}/content")
        state = rows.groupBy("digest").agg(F.min(_order()).alias("stays"), F.count(F.lit(1)).alias("copies"))
        changes = f"{self.root}/state-changes"

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{changes}/batch={number}")

        with _on_disk(self.spark):
            run = (
                state.writeStream.outputMode("update")
                .option("checkpointLocation", f"{self.root}/state")
                .trigger(availableNow=True)
                .foreachBatch(keep)
                .start()
            )
            run.awaitTermination()

    def state(self) -> DataFrame:
        """digest, stays, copies: the newest state row of each digest."""
        changes = self.spark.read.parquet(f"{self.root}/state-changes")
        if len(changes.select("batch").distinct().take(2)) == 1:
            return changes.drop("batch")
        newest = changes.groupBy("digest").agg(F.max(F.struct("batch", "stays", "copies")).alias("x"))
        return newest.select("digest", "x.stays", "x.copies")

    def resolve(self) -> DataFrame:
        """One row per stored row: doc_id, arrival, locator, digest, keep (stays), copies."""
        content = self.content()
        repeated = if_small(saved(self.state().where("copies > 1"), "repeated"))
        place = F.struct("arrival", "locator")
        stays = F.struct("stays.arrival", "stays.locator")
        shared = content.join(repeated, "digest")
        first = shared.where(place == stays).select("digest", F.col("content").alias("kept_content"))
        hits = shared.where(place != stays).drop("copies", "stays")
        differs = saved(
            hits.join(first, "digest").where("content <> kept_content").drop("kept_content"), "differing"
        )
        rows = content.drop("content").join(repeated, "digest", "left")
        rows = rows.withColumns(
            {"stays": F.coalesce("stays", _order()), "copies": F.coalesce("copies", F.lit(1).cast("long"))}
        )
        return rows if differs.isEmpty() else _split(rows, differs)


def _split(rows: DataFrame, differs: DataFrame) -> DataFrame:
    """Give rows whose digest is equal but whose bytes differ their own groups."""
    groups = differs.groupBy("digest", "content").agg(
        F.min(_order()).alias("own"), F.count(F.lit(1)).alias("own_copies")
    )
    own = differs.join(groups, ["digest", "content"]).select("arrival", "locator", "own", "own_copies")
    gone = differs.groupBy("digest").agg(F.count(F.lit(1)).alias("gone"))
    rows = rows.join(own, ["arrival", "locator"], "left").join(gone, "digest", "left")
    copies = F.coalesce("own_copies", F.col("copies") - F.coalesce("gone", F.lit(0)))
    return rows.withColumns({"stays": F.coalesce("own", "stays"), "copies": copies}).drop("own", "own_copies", "gone")


@contextmanager
def _on_disk(spark: SparkSession):
    before = {key: spark.conf.get(key, None) for key in ON_DISK}
    for key, value in ON_DISK.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Deduplicate one table in a new store: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, so they equal each other, empty texts and nothing else; a text of white space
    only is one space. Of rows with the same doc_id and text one is kept; a null doc_id is kept only if its
    group has no other, and keep_id is null then. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    store = Deduplicator(spark, shared_folder(spark, "exact-dedup"))
    store.ingest(docs)
    store.advance()
    kept = F.struct("arrival", "locator") == F.struct("stays.arrival", "stays.locator")
    return store.resolve().select(
        "doc_id",
        F.col("stays.doc_id").alias("keep_id"),
        F.col("copies").alias("group_size"),
        kept.alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
