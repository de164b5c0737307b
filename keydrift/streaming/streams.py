"""Streaming forms: comparison of arriving documents, history sink, change feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.utils import AnalysisException

from keydrift.operators.changes import apply_changes
from keydrift.operators.diff import missing_keys
from keydrift.plans.lookup import look_up

SALTS = 64


def missing_against_baselines(
    sources: DataFrame,
    baselines: DataFrame,
    key: str = "baseline_id",
    keep: tuple[str, ...] = ("pair_id",),
    hot: tuple[str, ...] = (),
) -> DataFrame:
    """Missing keys of arriving documents (``keep…, key, source_json``), stateless.

    ``baselines`` (``key, target_json``, one row per key) is static. A batch needs no more: adaptive
    execution splits the documents of a baseline that most refer to. On a stream name such baselines
    as ``hot``: only they are offered under several numbers, of which each document takes one by its
    content.
    """
    if not hot:
        return missing_keys(look_up(sources, baselines, key), keep)
    is_hot = F.col(key).isin(*hot)
    numbers = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    salt = F.when(is_hot, F.pmod(F.xxhash64(*keep, "source_json"), F.lit(SALTS))).otherwise(0)
    offered = baselines.withColumn("_salt", F.explode(numbers))
    pairs = sources.withColumn("_salt", salt.cast("int")).join(offered, [key, "_salt"])
    return missing_keys(pairs, keep)


def history_writer(rows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """History rows of a stream as an append-only Parquet table."""
    return (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )


def change_log_writer(changes: DataFrame, log: str, feed: str, checkpoint: str, mode: str = "append") -> DataStreamWriter:
    """Append the change feed named ``feed`` to a log with one folder per feed and micro-batch.

    A batch that runs again replaces its own folder, so the log holds each change once. A feed
    belongs to the checkpoint it was begun with: another one, whose batches would be numbered from 0
    again, is refused. Cost per batch follows the batch, not the catalog.
    """
    spark = changes.sparkSession
    owner = f"{log}/_owners/{feed}"
    try:
        begun = spark.read.text(owner).first()[0]
    except AnalysisException:
        spark.createDataFrame([(checkpoint,)], "value string").coalesce(1).write.text(owner)
    else:
        if begun != checkpoint:
            raise ValueError(f"feed {feed!r} of {log} was begun with checkpoint {begun}, not {checkpoint}")

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/feed={feed}/batch_id={batch_id}")

    return (
        changes.writeStream.foreachBatch(store)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
    )


def _logged(spark: SparkSession, log: str, schema, taken: dict[str, int]) -> DataFrame:
    """The log's changes in batches later than those taken over, by feed."""
    full = schema.add("feed", "string").add("batch_id", "long") if "feed" not in schema.fieldNames() else schema
    rows = spark.read.schema(full).parquet(log)
    last: Column = F.lit(-1).cast("long")
    for feed, batch in taken.items():
        last = F.when(F.col("feed") == feed, batch).otherwise(last)
    return rows.where(F.col("batch_id") > last)


def current_catalog(
    spark: SparkSession, base: DataFrame, log: str, schema, fields: tuple[str, ...], taken: dict[str, int] | None = None
) -> DataFrame:
    """The catalog now: the base snapshot with every change applied that it does not hold yet.

    ``taken`` is what :func:`roll_forward` returned with the base; older batches are pruned by folder.
    """
    names = [n for n in schema.fieldNames() if n not in ("feed", "batch_id")]
    return apply_changes(base, _logged(spark, log, _copy(schema), taken or {}).select(*names), fields)


def roll_forward(
    spark: SparkSession,
    base: DataFrame,
    log: str,
    schema,
    fields: tuple[str, ...],
    path: str,
    taken: dict[str, int] | None = None,
) -> tuple[DataFrame, dict[str, int]]:
    """Write a snapshot to ``path`` that takes over the log as it is, and tell up to which batch.

    Later reads apply only what follows. A change in a later batch must have a later ``seq`` than
    the same id's changes taken over.
    """
    taken = taken or {}
    rows = _logged(spark, log, _copy(schema), taken)
    last = {r.feed: r.last for r in rows.groupBy("feed").agg(F.max("batch_id").alias("last")).collect()}
    upto = {**taken, **last}
    held: Column = F.lit(False)
    for feed, batch in last.items():
        held = held | ((F.col("feed") == feed) & (F.col("batch_id") <= batch))
    names = [n for n in schema.fieldNames() if n not in ("feed", "batch_id")]
    apply_changes(base, rows.where(held).select(*names), fields).write.mode("errorifexists").parquet(path)
    return spark.read.schema(base.schema).parquet(path), upto


def _copy(schema):
    return type(schema)(list(schema.fields))
