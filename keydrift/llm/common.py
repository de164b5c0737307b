"""What the operators share: the shared folder, size-checked broadcasts, connected components, Arrow texts."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of at most a few dozen bytes that a broadcast may hold; beyond it the same join shuffles.
BROADCAST_ROWS = 200_000
#: Text bytes that a numpy step takes at a time; one longer text is taken whole.
CHUNK_BYTES = 1_000_000
#: Rows that go to Python at a time, and about the bytes of them.
BATCH_ROWS, BATCH_BYTES = 2_000, 1 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; a folder of this machine only where that is unset and Spark is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def saved(frame: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """The frame as a table written to the shared folder: lineage ends, and a lost executor loses nothing. Large rows
    come in files of so many at most, since files are written and read thousands of rows at a time."""
    path = shared_folder(frame.sparkSession, name)
    (frame.write.option("maxRecordsPerFile", most) if most else frame.write).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def checkpointed(frame: DataFrame) -> DataFrame:
    shared_folder(frame.sparkSession, "")
    return frame.checkpoint()


def if_small(frame: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame with a broadcast hint if it has at most so many rows, as it is otherwise. Counts, so give it saved rows."""
    return F.broadcast(frame) if frame.limit(rows + 1).count() <= rows else frame


def crc_fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def text_digest() -> Column:
    """The text's digest, which with doc_id names a row; null counts as empty."""
    return F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("text_sha256")


def hashed_sample(frame: DataFrame, rows: int, *columns: str) -> DataFrame:
    """At most so many rows, those with the smallest hash of the columns. A first cut by hash leaves little more
    than that, so no task passes on a sample of its own size."""
    pick = F.xxhash64(*columns)
    share = min(1.0, 1.5 * rows / max(1, frame.count()))
    return frame.where(F.pmod(pick, F.lit(1 << 32)) < int(share * (1 << 32))).orderBy(pick, *columns).limit(rows)


def components(links: DataFrame) -> DataFrame:
    """node, component for links (a, b): the smallest node that can be reached.

    Labels spread along the links and then jump to the label of their label, so that rounds grow with the
    logarithm of a chain's length. Minima are combined before each shuffle; a root shared by many nodes is
    the hot side of a plain join, which adaptive execution splits.
    """
    both = checkpointed(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    )
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        told = (
            both.join(labels, both.a == labels.node)
            .groupBy(F.col("b").alias("node"))
            .agg(F.min("component").alias("heard"))
        )
        lower = labels.join(told, "node").select("node", F.least("component", "heard").alias("step"))
        root = labels.select(F.col("node").alias("step"), F.col("component").alias("root"))
        after = checkpointed(
            lower.join(root, "step").select("node", F.least("step", "root").alias("component"))
        )
        moved = after.join(labels.withColumnRenamed("component", "before"), "node").where("component <> before")
        done = moved.isEmpty()
        labels = after
        if done:
            return labels


def mapped(frame: DataFrame, run: Callable, schema: str) -> DataFrame:
    """frame.mapInArrow, with batches of bounded rows and bytes; a longer text is a batch of its own.

    Batches are held outside the heap of the executor, which keeps the memory of the largest ones.
    """
    conf = frame.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        given = conf.get(name).lower().removesuffix("b")
        if not (given.isdigit() and 0 < int(given) <= most):
            conf.set(name, most)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        given_back()  # a worker that waits for its next task holds nothing that the last one freed

    return frame.mapInArrow(tidy, schema)


def given_back() -> None:
    """Return freed memory of this worker to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, nulls as empty, and the n + 1 places where its values begin and end."""
    column = column.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about so many bytes."""
    _, at = utf8(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, side="right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (finalizer of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def numbers(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def kept_by_worker(name: str, make: Callable[[], object]) -> object:
    """An object that later tasks of the Python worker find again, until one of them asks for another object."""
    store = sys.modules.setdefault("keydrift_worker", types.ModuleType("keydrift_worker"))
    if getattr(store, "kept_name", None) != name:
        store.kept = store.kept_name = None
        given_back()  # what was kept before, and below what making took for a while
        store.kept = make()
        given_back()
        store.kept_name = name
    return store.kept
