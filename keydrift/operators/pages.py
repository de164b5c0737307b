"""Pages of a listing, newest first, from a snapshot sorted once: a page reads the files it lies in."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructType

from keydrift.operators.catalog import newest_first

#: Rows of a file, about; a page reads one or two files more than it fills.
FILE_ROWS = 100_000

#: ``create_at`` and ``id`` of a page's last row.
Place = tuple[datetime | None, str | None]


def write_listing(catalog: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Sort a catalog as :func:`newest_first` does, in files by ranges of its order, and note what each file holds."""
    spark, count = catalog.sparkSession, catalog.count()
    order = (F.col("create_at").desc_nulls_first(), F.col("id").asc_nulls_first())
    ranged = catalog.repartitionByRange(max(1, -(-count // file_rows)), *order).withColumn("chunk", F.spark_partition_id())
    ranged.sortWithinPartitions("chunk", *order).write.partitionBy("chunk").parquet(f"{path}/rows")
    # Times descend, so a range's last row has the least of them, and none only if no row has one.
    written = spark.read.schema(StructType([*catalog.schema.fields]).add("chunk", IntegerType())).parquet(f"{path}/rows")
    bounds = written.groupBy("chunk").agg(F.min("create_at").alias("create_at"), F.count("*").alias("n_rows"))
    last = written.join(bounds.withColumnRenamed("create_at", "_last"), "chunk").where(F.col("create_at").eqNullSafe(F.col("_last")))
    last = last.groupBy("chunk", "create_at", "n_rows").agg(F.max("id").alias("id"))
    last.repartition(1).sortWithinPartitions("chunk").write.parquet(f"{path}/bounds")


def is_after(place: Place) -> Column:
    """Rows that follow a place in the order of the listing: no time first, then descending; ids ascending."""
    at, last_id = place
    later_id = F.col("id").isNotNull() if last_id is None else F.coalesce(F.col("id") > F.lit(last_id), F.lit(False))
    if at is None:
        return F.col("create_at").isNotNull() | later_id
    return F.coalesce((F.col("create_at") < F.lit(at)) | ((F.col("create_at") == F.lit(at)) & later_id), F.lit(False))


def chunks_of(spark: SparkSession, path: str, size: int, after: Place | None = None) -> list[int]:
    """Files in which the page lies: the first one with rows after the place, then as many as surely hold ``size`` more."""
    bounds = spark.read.schema("chunk int, create_at timestamp, n_rows bigint, id string").parquet(f"{path}/bounds")
    left = bounds if after is None else bounds.where(is_after(after))
    wanted, held = [], 0
    for place, row in enumerate(left.orderBy("chunk").toLocalIterator()):
        if held >= size:
            break
        wanted.append(row.chunk)
        # The first file may lie partly before the place.
        held += row.n_rows if after is None or place > 0 else 0
    return wanted


def page(spark: SparkSession, schema: StructType, path: str, size: int, after: Place | None = None) -> DataFrame:
    """The ``size`` rows that follow ``after`` (the first ones without it), in order; other files are not read."""
    rows = spark.read.schema(StructType([*schema.fields]).add("chunk", IntegerType())).parquet(f"{path}/rows")
    rows = rows.where(F.col("chunk").isin(*chunks_of(spark, path, size, after)))
    return newest_first(rows if after is None else rows.where(is_after(after)), size).drop("chunk")
