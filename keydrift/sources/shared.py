"""Tables written along the way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDER = "spark.checkpoint.dir"


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which must be set unless Spark runs in this process."""
    root = spark.conf.get(_FOLDER, None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{_FOLDER} must name a folder that driver and executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set(_FOLDER, root)
        spark.sparkContext.setCheckpointDir(root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a table of its own: what made it is not run again."""
    path = new_folder(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
