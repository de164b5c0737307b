"""Reading and writing tables and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from keydrift.sources.schemas import NOTES, QUERIES, USERS

#: Documents that one task walks, about.
SPREAD_ROWS = 20_000


def scan_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUERIES).parquet(path)


def scan_notes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NOTES).parquet(path)


def scan_users(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(USERS).parquet(path)


def document_pairs(spark: SparkSession, target_dir: str, source_dir: str) -> DataFrame:
    """Two folders of JSON files, paired by file name without extension: ``pair_id`` is the name.

    A name present on one side only gives NULL on the other, which compares as blank. Where a side
    has a name with several extensions, the full names are the ids, so that nothing pairs crosswise.
    """

    def side(folder: str, column: str) -> DataFrame:
        read = spark.read.text(folder, wholetext=True)
        # The name comes as in a URL, but for the plus sign.
        file = F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B")))
        return read.select(file.alias("file"), F.col("value").alias(column))

    return paired(side(target_dir, "target_json"), side(source_dir, "source_json"))


def paired(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """The files (``file`` and columns of their own) of two folders side by side, named as :func:`document_pairs` says."""
    targets, sources = (s.withColumn("stem", F.regexp_replace("file", r"\.[^.]*$", "")) for s in (targets, sources))
    repeated = [s.groupBy("stem").count().where("count > 1").select("stem") for s in (targets, sources)]
    repeated = repeated[0].union(repeated[1]).distinct().withColumn("_repeated", F.lit(True))

    def named(frame: DataFrame) -> DataFrame:
        known = frame.join(repeated, "stem", "left")
        name = F.when(F.col("_repeated").isNotNull(), F.col("file")).otherwise(F.col("stem"))
        return known.withColumn("pair_id", name).drop("stem", "file", "_repeated")

    return named(targets).join(named(sources), "pair_id", "full")


def write_documents(merged: DataFrame, path: str, as_text: bool = False) -> None:
    """Printed documents as Parquet, or as text files with one JSON object (id, document) per line."""
    if as_text:
        merged.select("pair_id", "merged_json").write.mode("overwrite").json(path)
    else:
        merged.write.mode("overwrite").parquet(path)


def write_snapshot(table: DataFrame, path: str) -> None:
    """A new version of a table at a path of its own; existing data is not replaced."""
    table.write.mode("errorifexists").parquet(path)


def _tasks(frame: DataFrame) -> int:
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return max(cores, -(-frame.count() // SPREAD_ROWS))


def ordered(frame: DataFrame, by: str) -> DataFrame:
    """The rows in order, in tasks like those of :func:`spread`. Adaptive execution leaves their number as it is."""
    return frame.repartitionByRange(_tasks(frame), by).sortWithinPartitions(by)


def spread(frame: DataFrame, on: Column | str | None = None) -> DataFrame:
    """Tasks of at most about ``SPREAD_ROWS`` rows, and work for every core.

    Documents are heavy to walk compared with the columns they are made of, so splits by bytes would leave most cores
    idle on a small table and hold millions of documents on a large one. The rows are counted, which files tell without
    being read through; a scan with as many splits is returned as it is.
    """
    tasks = _tasks(frame)
    if frame.rdd.getNumPartitions() >= tasks:
        return frame
    return frame.repartition(tasks, on) if on is not None else frame.repartition(tasks)
