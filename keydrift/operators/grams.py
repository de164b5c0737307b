"""Literal substring search by an index of three-letter grams, for catalogs too large to scan for every term.

The index is three tables: the catalog's rows in shelves by a hash of their id, postings ``gram, id`` in parts by a hash
of the gram, and how many rows hold each gram. A search reads the parts of a term's rarest grams, then the shelves that
hold candidates, and decides with the same test as a scan. So results are those of a scan, whatever the index holds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from keydrift.operators.catalog import contains_text, matches_facet, newest_first

#: Rows of a folder, about, and folders of rows and of postings at most. Inside one, rows are sorted, so that row groups
#: are skipped; a folder may hold any number of files.
FOLDER_ROWS, MOST_FOLDERS = 2_000, 256
#: Grams of a term that are looked up; the rarest ones leave few candidates.
LOOKED_UP = 4
#: Tasks and files that the postings of one folder are dealt out to by a hash of the id.
SALTS = 8


def grams_of(text: Column) -> Column:
    """Distinct runs of three letters of the lower-cased text; none for NULL and shorter texts."""
    runs = F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))"), F.lit(1))
    return F.coalesce(F.array_distinct(runs), F.array().cast("array<string>"))


def _folder(column: Column, count: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(count)).cast("int")


@dataclass(frozen=True)
class GramIndex:
    """A written index: where it is, the searched columns, the schema of the catalog's rows and the number of folders."""

    path: str
    columns: tuple[str, ...]
    schema: StructType
    folders: int

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(StructType([*self.schema.fields]).add("shelf", IntegerType())).parquet(f"{self.path}/rows")

    def postings(self, spark: SparkSession) -> DataFrame:
        schema = StructType().add("gram", StringType()).add(self.schema["id"]).add("part", IntegerType())
        return spark.read.schema(schema).parquet(f"{self.path}/postings")

    def frequencies(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("gram string, n_rows bigint, part int").parquet(f"{self.path}/frequencies")


def write_index(catalog: DataFrame, columns: tuple[str, ...], path: str, folders: int | None = None) -> GramIndex:
    """Index the text ``columns`` of a catalog with an ``id``, NULL ids included.

    ``folders`` follows from the number of rows where it is not given. Rows are laid out by ranges that end in the id. Postings are
    dealt out by hash, so that grams are not taken from the texts once more to find ranges; by a hash of the id too, so
    that a frequent gram fills several tasks and files.
    """
    folders = folders or min(MOST_FOLDERS, 1 + catalog.count() // FOLDER_ROWS)
    spark, index = catalog.sparkSession, GramIndex(path, columns, catalog.schema, folders)
    shelved = catalog.withColumn("shelf", _folder(F.col("id"), folders)).repartitionByRange("shelf", "id")
    shelved.sortWithinPartitions("shelf", "id").write.partitionBy("shelf").parquet(f"{path}/rows")
    grams = F.array_distinct(F.concat(*(grams_of(F.col(name)) for name in columns)))
    postings = catalog.select(F.explode(grams).alias("gram"), "id").withColumn("part", _folder(F.col("gram"), folders))
    postings = postings.repartition("part", _folder(F.col("id"), SALTS)).sortWithinPartitions("part", "gram", "id")
    postings.write.partitionBy("part").parquet(f"{path}/postings")
    counts = index.postings(spark).groupBy("part", "gram").agg(F.count("*").alias("n_rows"))
    counts.repartition("part").sortWithinPartitions("part", "gram").write.partitionBy("part").parquet(f"{path}/frequencies")
    return index


def rarest_grams(spark: SparkSession, index: GramIndex, term: str) -> list[tuple[str, int]] | None:
    """The term's rarest grams with their parts; none of them if a gram is in no row, None for a term under three letters.

    What comes to the driver is at most one row for each letter of the term.
    """
    asked = F.explode(grams_of(F.lit(term))).alias("gram")
    grams = [(r.gram, r.part) for r in spark.range(1).select(asked).select("gram", _folder(F.col("gram"), index.folders).alias("part")).collect()]
    if not grams:
        return None
    held = index.frequencies(spark).where(_any_of(grams)).collect()
    if len(held) < len(grams):
        return []
    return [(r.gram, r.part) for r in sorted(held, key=lambda r: (r.n_rows, r.gram))[:LOOKED_UP]]


def _any_of(grams: list[tuple[str, int]]) -> Column:
    return F.col("part").isin(*{part for _, part in grams}) & F.col("gram").isin(*[gram for gram, _ in grams])


def candidate_ids(spark: SparkSession, index: GramIndex, grams: list[tuple[str, int]]) -> DataFrame:
    """``id, shelf`` of rows that hold all the grams, by one aggregation that combines before its shuffle."""
    bit: Column = F.lit(0)
    for place, (gram, _) in enumerate(grams):
        bit = F.when(F.col("gram") == gram, F.lit(1 << place)).otherwise(bit)
    held = index.postings(spark).where(_any_of(grams)).groupBy("id").agg(F.bit_or(bit).alias("held"))
    return held.where(F.col("held") == (1 << len(grams)) - 1).select("id", _folder(F.col("id"), index.folders).alias("shelf"))


def candidate_rows(spark: SparkSession, index: GramIndex, term: str) -> DataFrame:
    """Rows that may contain the term: only shelves with a candidate are read. All rows for a term under three letters."""
    rows, grams = index.rows(spark), rarest_grams(spark, index, term)
    if grams is None:
        return rows
    if not grams:
        return rows.where("false")
    found = candidate_ids(spark, index, grams)
    shelves = [r.shelf for r in found.select("shelf").distinct().collect()]  # at most MOST_FOLDERS
    asked = found.select(F.col("id").alias("_id"))
    return rows.where(F.col("shelf").isin(*shelves)).join(asked, F.col("id").eqNullSafe(F.col("_id")), "left_semi")


def search_index(
    spark: SparkSession, index: GramIndex, term: str = "", facet: str | None = None, facet_term: str = ""
) -> DataFrame:
    """Rows of the indexed catalog that contain the term as :func:`contains_text` says, newest first."""
    wanted = contains_text(index.columns, term)
    if facet is not None:
        wanted = wanted & matches_facet(facet, facet_term)
    return newest_first(candidate_rows(spark, index, term).where(wanted).drop("shelf"))
