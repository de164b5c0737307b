"""The corpus pipeline: documents in, packed sequences out."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keydrift.llm.common import if_small, saved, text_digest
from keydrift.llm.exact_dedup import exact_duplicates, normalised, sha256
from keydrift.llm.language_id import UNKNOWN, languages
from keydrift.llm.near_dedup import near_duplicates
from keydrift.llm.packing import packed
from keydrift.llm.queries import tokenizer
from keydrift.llm.toxicity import toxic_documents

#: SQL expresses neither the trained stages nor the tokens.
ORACLE_SQL = None
#: A document whose language is less probable than this is rejected like one without a letter.
SURE = 0.35

Stage = Callable[[SparkSession, DataFrame | None, str], DataFrame]


def _documents(spark: SparkSession, docs: DataFrame | None, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet") if docs is None else docs


def _without(docs: DataFrame, rejected: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that no rejected row equals in the keys, nulls taken as equal."""
    rejected = if_small(saved(rejected.select([F.col(k).alias(f"_{k}") for k in keys]).distinct(), "rejected"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return docs.join(rejected, same, "left_anti")


def _judged(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rows whose text is not rejected under their doc_id: another text of that id, or of no id, stays."""
    names = docs.columns
    named = docs.withColumn("_text", text_digest())
    return _without(named, rejected.select("doc_id", F.col("text_sha256").alias("_text")), ["doc_id", "_text"]).select(names)


def language_id(spark: SparkSession, docs: DataFrame | None, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; it is learned from the documents' own labels."""
    docs = _documents(spark, docs, sf_dir)
    unclear = (F.col("lang_pred") == UNKNOWN) | (F.col("score") < SURE)
    return _judged(docs, languages(docs).where(unclear))


def toxicity(spark: SparkSession, docs: DataFrame | None, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    docs = _documents(spark, docs, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _judged(docs, toxic_documents(docs, labels).where("predicted = 1"))


def exact_dedup(spark: SparkSession, docs: DataFrame | None, sf_dir: str) -> DataFrame:
    """One document of each text. Rows that repeat both doc_id and text become one."""
    docs = _documents(spark, docs, sf_dir)
    named = docs.withColumn("text_sha256", sha256(normalised(F.col("text"))))
    rows = saved(exact_duplicates(docs).where("not kept").select("doc_id", "keep_id", "text_sha256"), "not-kept")
    again = rows.where("doc_id <=> keep_id")
    kept = _without(named, rows.where("not doc_id <=> keep_id"), ["doc_id", "text_sha256"])
    if not again.isEmpty():
        repeated = again.select("doc_id", "text_sha256").distinct()
        single = _without(kept, repeated, ["doc_id", "text_sha256"])
        same = kept["doc_id"].eqNullSafe(repeated["doc_id"]) & (kept["text_sha256"] == repeated["text_sha256"])
        first = kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text_sha256"])
        kept = single.unionByName(first)
    return kept.select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame | None, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id.

    Where ids don't tell rows apart (null ones, or an id of several texts) rows are numbered in their place.
    """
    docs = _documents(spark, docs, sf_dir)
    ids = docs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids")).first()
    if ids.n == ids.ids:
        return _without(docs, near_duplicates(docs).where("not kept"), ["doc_id"]).select(docs.columns)
    named = saved(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    numbered = named.select(F.col("_row").alias("doc_id"), "text")
    left = near_duplicates(numbered).where("not kept").select(F.col("doc_id").alias("_row"))
    return _without(named, left, ["_row"]).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame | None, sf_dir: str) -> DataFrame:
    """Training sequences: the pieces of all documents with their ids."""
    return packed(_documents(spark, docs, sf_dir), tokenizer("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over what the stage before it kept."""
    docs = _documents(spark, None, sf_dir)
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
