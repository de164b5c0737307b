"""Hot keys found by a mergeable sketch, and arriving documents compared under as many salts as their key needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import DataType, LongType, StructField, StructType

from keydrift.operators.diff import missing_keys

#: Parts that a key with all rows is dealt to; keys with less than one part's share stay whole.
SALTS = 64
#: Keys that a sketch counts; it errs by less than their share, so hot keys are never missed.
TRACKED = 1000
#: Micro-batches whose sketches together tell which keys are hot.
WINDOW = 16


def key_sketch(rows: DataFrame, key: str) -> DataFrame:
    """One row: ``sketch`` of the most frequent keys and ``n`` rows. Sketches of parts are merged before any shuffle of
    rows, and those of different batches by :func:`hot_keys`."""
    return rows.agg(F.expr(f"approx_top_k_accumulate(`{key}`, {TRACKED})").alias("sketch"), F.count(key).alias("n"))


def hot_keys(sketches: DataFrame, key: str, kind: DataType) -> DataFrame:
    """``key, salts`` of the keys with more than 1/SALTS of all rows that the sketches have seen: fewer than SALTS rows."""
    # Grouped, as an aggregate without groups would also have to merge no sketches at all.
    merged = sketches.where("n > 0").groupBy(F.lit(1).alias("all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch), {SALTS})").alias("top"), F.sum("n").alias("n"))
    each = merged.select("n", F.inline("top")).where(F.col("count") * SALTS > F.col("n"))
    return each.select(F.col("item").cast(kind).alias(key), F.ceil(F.col("count") * SALTS / F.col("n")).cast("int").alias("salts"))


def missing_salted(sources: DataFrame, baselines: DataFrame, hot: DataFrame, key: str = "baseline_id", keep: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """Missing keys of documents whose hot baselines (``key, salts``) are offered under several numbers, of which each
    document takes one by its content. Rows as those of a plain lookup; documents without baseline have none."""
    hot = F.broadcast(hot.limit(SALTS))
    many = F.coalesce("salts", F.lit(1))
    offered = baselines.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), many - 1))).drop("salts")
    salt = F.pmod(F.xxhash64(*keep, "source_json"), many).cast("int")
    asked = sources.join(hot, key, "left").withColumn("_salt", salt).drop("salts")
    return missing_keys(asked.join(offered, [key, "_salt"]), keep)


def missing_against_hot_baselines(sources: DataFrame, baselines: DataFrame, key: str = "baseline_id", keep: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """Missing keys of a table of documents, whose hot baselines are found first: one pass over the keys alone."""
    return missing_salted(sources, baselines, hot_keys(key_sketch(sources, key), key, sources.schema[key].dataType), key, keep)


def _sketches(spark: SparkSession, folder: str, batch_id: int, first: DataFrame) -> DataFrame:
    schema = StructType([*first.schema.fields, StructField("batch_id", LongType())])
    return spark.read.schema(schema).parquet(folder).where(F.col("batch_id").between(batch_id - WINDOW + 1, batch_id))


def missing_writer(
    sources: DataFrame, baselines: DataFrame, path: str, checkpoint: str, key: str = "baseline_id", keep: tuple[str, ...] = ("pair_id",)
) -> DataStreamWriter:
    """Missing keys of a stream of documents, written per micro-batch, whatever share one baseline has of them.

    Each batch is sketched first (its keys only); with the sketches of the batches before it tells the number of salts
    of each hot baseline. A batch that runs again replaces its sketch and its rows.
    """
    kind = sources.schema[key].dataType

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        sketch = key_sketch(batch, key)
        sketch.write.mode("overwrite").parquet(f"{checkpoint}-sketches/batch_id={batch_id}")
        hot = hot_keys(_sketches(spark, f"{checkpoint}-sketches", batch_id, sketch), key, kind)
        found = missing_salted(batch, baselines, hot, key, keep)
        found.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return sources.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
