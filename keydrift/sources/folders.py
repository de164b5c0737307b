"""Folders of documents that are read again only where files changed.

A store keeps, per refresh, a manifest of both folders (path, length, time, digest, and the refresh that read the file)
and the texts read by that refresh. Files are listed without being opened; one is read if it is new or its length or
time differs, and counts as changed if its digest differs too. Spark's scans leave out empty files: an
emptied one counts as removed, and its side is NULL, which compares as blank. A refresh writes its manifest last: one that was cut
short is run again under the same number. One writer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import batched

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from keydrift.sources.tables import paired

#: Files that one scan names. Where more than this share of a folder is to be read, the folder is named instead.
FILES_PER_SCAN, WHOLE = 10_000, 0.5
_MANIFEST = "side string, path string, file string, length long, modified timestamp, digest string, read_in long"
_TEXTS = "side string, path string, text string, digest string"
_SIDES = ("target", "source")


@dataclass(frozen=True)
class FolderStore:
    """Where the manifests and texts of a target and a source folder are kept."""

    path: str
    target_dir: str
    source_dir: str

    def folder(self, side: str) -> str:
        return self.target_dir if side == "target" else self.source_dir

    def manifest(self, spark: SparkSession, version: int) -> DataFrame:
        """The files of a refresh; none for version 0, the state before the first."""
        if not version:
            return spark.createDataFrame([], _MANIFEST)
        return spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/version={version}")

    def version(self, spark: SparkSession) -> int:
        """The number of the last refresh that was finished, 0 before the first."""
        try:
            found = spark.read.schema(f"{_MANIFEST}, version long").parquet(f"{self.path}/manifest")
        except AnalysisException:
            return 0
        return found.agg(F.max("version")).first()[0] or 0


def _listed(spark: SparkSession, store: FolderStore) -> DataFrame:
    """The files there are now. Columns that the scan leaves out are not read, so no file is opened."""

    def side(name: str) -> DataFrame:
        files = spark.read.format("binaryFile").load(store.folder(name))
        return files.select(
            F.lit(name).alias("side"), "path", F.regexp_extract("path", "[^/]*$", 0).alias("file"),
            "length", F.col("modificationTime").alias("modified"),
        )

    return reduce(DataFrame.unionByName, map(side, _SIDES))


def _texts(spark: SparkSession, store: FolderStore, stale: DataFrame, side: str) -> DataFrame:
    """Texts of the side's files among ``stale``; only those are opened, unless they are most of the folder."""
    mine = stale.where(F.col("side") == side)
    counts = mine.agg(F.count("*").alias("n"), F.count_if("stale").alias("stale")).first()
    mine = mine.where("stale").select("path")
    if counts.stale > WHOLE * counts.n:
        read = spark.read.format("binaryFile").load(store.folder(side)).join(mine, "path", "left_semi")
    else:
        # Spark lists the files of any scan on the driver; here it lists the changed ones. Their texts stay on executors.
        quoted = mine.select(F.regexp_replace("path", r"([\[\]{}*?\\])", r"\\$1")).toLocalIterator()
        scans = [
            spark.read.format("binaryFile").load([r[0] for r in some]) for some in batched(quoted, FILES_PER_SCAN)
        ]
        if not scans:
            return spark.createDataFrame([], _TEXTS)
        read = reduce(DataFrame.unionByName, scans)
    return read.select(F.lit(side).alias("side"), "path", F.col("content").cast("string").alias("text"), F.sha2("content", 256).alias("digest"))


def refresh(spark: SparkSession, store: FolderStore) -> int:
    """Read what is new or changed in the two folders and note all files there are now. Gives the refresh's number."""
    last = store.version(spark)
    version = last + 1
    kept, here = f"{store.path}/listed/version={version}", f"{store.path}/texts/version={version}"
    before = store.manifest(spark, last).select(
        "side", "path", F.col("length").alias("old_length"), F.col("modified").alias("old_modified"), "digest", "read_in"
    )
    same = F.col("length").eqNullSafe(F.col("old_length")) & F.col("modified").eqNullSafe(F.col("old_modified"))
    listed = _listed(spark, store).join(before, ["side", "path"], "left").withColumn("stale", ~same)
    # Written, so that the files read are those that the manifest names.
    listed.write.mode("overwrite").parquet(kept)
    listed = spark.read.schema(listed.schema).parquet(kept)
    read = reduce(DataFrame.unionByName, [_texts(spark, store, listed, side) for side in _SIDES])
    read.write.mode("overwrite").parquet(here)
    digests = spark.read.schema(_TEXTS).parquet(here).select("side", "path", F.col("digest").alias("now"))
    known = listed.join(digests, ["side", "path"], "left")
    manifest = known.select(
        "side", "path", "file", "length", "modified", F.coalesce("now", "digest").alias("digest"),
        F.when(F.col("now").isNotNull(), F.lit(version)).otherwise(F.col("read_in")).alias("read_in"),
    )
    manifest.write.mode("overwrite").parquet(f"{store.path}/manifest/version={version}")
    return version


def _pairing(manifest: DataFrame) -> DataFrame:
    """``pair_id`` with path, digest and reading refresh of each side; a side without file is NULL."""

    def side(name: str) -> DataFrame:
        file = F.struct("path", "digest", "read_in").alias(name)
        return manifest.where(F.col("side") == name).select("file", file)

    return paired(side("target"), side("source"))


def _with_texts(spark: SparkSession, store: FolderStore, pairs: DataFrame) -> DataFrame:
    """``pair_id, target_json, source_json``: each text from the refresh that read it, other refreshes' are not opened."""
    texts = spark.read.schema(f"{_TEXTS}, version long").parquet(f"{store.path}/texts")
    for side in _SIDES:
        own = texts.where(F.col("side") == side).select(
            F.col("path").alias("_path"), F.col("version").alias("_version"), F.col("text").alias(f"{side}_json")
        )
        at = (F.col(f"{side}.path") == F.col("_path")) & (F.col(f"{side}.read_in") == F.col("_version"))
        pairs = pairs.join(own, at, "left").drop("_path", "_version")
    return pairs.select("pair_id", "target_json", "source_json")


def stored_pairs(spark: SparkSession, store: FolderStore) -> DataFrame:
    """The pairs as of the last refresh, as ``document_pairs`` reads them, from the store."""
    return _with_texts(spark, store, _pairing(store.manifest(spark, store.version(spark))))


def changed_pairs(spark: SparkSession, store: FolderStore) -> tuple[DataFrame, DataFrame]:
    """What the last refresh changed: pairs that are new or have a side with another text, and the ``pair_id`` of those gone.

    Results kept per pair stay right if those of both are dropped and the first ones' are made again. A file that
    was written again with the same text changes nothing; a pair that lost one side is among the first.
    """
    version = store.version(spark)
    now, before = (_pairing(store.manifest(spark, v)) for v in (version, max(0, version - 1)))
    then = before.select("pair_id", F.struct("target.digest", F.col("source.digest").alias("other")).alias("then"))
    digests = F.struct("target.digest", F.col("source.digest").alias("other"))
    changed = now.join(then, "pair_id", "left").where(~F.col("then").eqNullSafe(digests)).drop("then")
    return _with_texts(spark, store, changed), before.join(now, "pair_id", "left_anti").select("pair_id")
