"""Documents as rows of members, and the comparison of two such tables.

The pairwise comparison in :mod:`keydrift.operators.diff` needs none of this. Member tables
serve when the two sides come from different tables and one is reused, such as a stored baseline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from keydrift.functions.once import built_once
from keydrift.functions.text import let
from keydrift.functions.tree import (
    compact_json,
    is_object,
    key_text,
    kind_of,
    levels,
    marked,
    open_object,
    rank_of,
)
from keydrift.operators.validate import is_valid_json
from keydrift.plans.session import require_settings

_NODES = "array<struct<ordinal:array<bigint>,path:array<string>,value:string>>"


def _all_members(document: Column) -> Column:
    root = F.struct(
        F.array().cast("array<bigint>").alias("ordinal"),
        F.array().cast("array<string>").alias("path"),
        document.alias("value"),
    )
    start = F.struct(
        F.array().cast(_NODES).alias("found"), F.array(root).cast(_NODES).alias("open")
    )

    def members(node: Column) -> Column:
        return F.transform(
            F.map_entries(open_object(node["value"])),
            lambda e, position: F.struct(
                F.flatten(F.array(node["ordinal"], rank_of(key_text(e["key"]), position))).alias("ordinal"),
                F.array_append(node["path"], key_text(e["key"])).alias("path"),
                e["value"].alias("value"),
            ),
        )

    def next_level(state: Column, _: Column) -> Column:
        return let(
            F.flatten(F.transform(state["open"], members)),
            lambda deeper: F.struct(
                F.flatten(F.array(state["found"], deeper)).alias("found"),
                F.filter(deeper, lambda n: is_object(n["value"])).alias("open"),
            ),
        )

    return F.aggregate(levels(document), start, next_level)["found"]


def source_members(
    documents: DataFrame, text: str, keep: tuple[str, ...] = ("pair_id",)
) -> DataFrame:
    """Every object member: ``keep…, ordinal, path, kind, value_json``; arrays stay closed."""
    walked = _walked(documents, text, keep).select(
        *keep, F.explode_outer("members").alias("node")
    )
    return walked.where("node IS NOT NULL").select(
        *keep,
        F.col("node.ordinal").alias("ordinal"),
        F.col("node.path").alias("path"),
        kind_of(F.col("node.value")).alias("kind"),
        built_once("compact value", lambda: compact_json(F.col("node.value"))).alias(
            "value_json"
        ),
    )


def target_paths(
    documents: DataFrame, text: str, keep: tuple[str, ...] = ("pair_id",)
) -> DataFrame:
    """Paths present in a document, the root (empty path) included: ``keep…, path``."""
    root = F.array(F.array().cast("array<string>"))
    paths = F.concat(root, F.transform("members", lambda n: n["path"]))
    present = _walked(documents, text, keep).select(*keep, F.explode_outer(paths).alias("path"))
    return present.where("path IS NOT NULL")


def _walked(documents: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    require_settings(documents.sparkSession)
    checked = documents.select(*keep, text, is_valid_json(F.col(text)).alias("valid"))
    opened = checked.select(
        *keep, F.when(F.col("valid"), marked(F.col(text))).alias("document")
    )
    walked = F.when(is_object(F.col("document")), _all_members(F.col("document"))).when(
        F.col("document").isNotNull(), F.array().cast(_NODES)
    )
    return opened.select(*keep, walked.alias("members"))


def missing_members(
    members: DataFrame, paths: DataFrame, key: tuple[str, ...] = ("pair_id",)
) -> DataFrame:
    """Members absent from ``paths`` whose parent is present: the topmost missing ones."""
    # Both joins look up the same columns under the same plan, so that the paths are made and shuffled once.
    present = paths.select(*(F.col(k).alias(f"_{k}") for k in key), F.col("path").alias("_present"))
    own = [F.col(k) == F.col(f"_{k}") for k in key]
    absent = members.join(present, [*own, F.col("path") == F.col("_present")], "left_anti")
    parent = F.slice("path", F.lit(1), F.size("path") - 1)
    topmost = absent.join(present, [*own, parent == F.col("_present")], "left_semi")
    return topmost.select(*key, "ordinal", "path", "value_json")


def missing_shared(
    members: DataFrame, paths: DataFrame, key: tuple[str, ...] = ("baseline_id",), keep: tuple[str, ...] = ("pair_id",)
) -> DataFrame:
    """The rows of :func:`missing_members` (with ``keep…``) for documents that share their targets.

    Members and target paths are united and aggregated once per ``(key…, path)``: what a million documents of one
    baseline ask for is combined to its distinct paths before the shuffle, and decided there. Members themselves meet
    only those decisions, as the large side of one plain join, whose hot partitions adaptive execution splits.
    """
    asked = members.select(*key, "path", F.lit(False).alias("present"), F.lit(True).alias("asked"))
    given = paths.select(*key, "path", F.lit(True).alias("present"), F.lit(False).alias("asked"))
    known = asked.union(given).groupBy(*key, "path").agg(F.max("present").alias("present"), F.max("asked").alias("asked"))
    # A path tells its own presence, and asks for its parent's; both meet in one more aggregation of distinct paths.
    parent = F.slice("path", F.lit(1), F.size("path") - 1)
    own = known.where("present").select(*key, F.col("path").alias("at"), F.lit(True).alias("present"), F.lit(None).cast("array<string>").alias("path"))
    lacked = known.where("asked AND NOT present").select(*key, parent.alias("at"), F.lit(None).cast("boolean").alias("present"), "path")
    both = own.union(lacked).withColumn("there", F.max("present").over(Window.partitionBy(*key, "at")))
    topmost = both.where("there AND path IS NOT NULL").select(*key, "path")
    found = members.join(topmost, [*key, "path"])
    return found.select(*keep, *key, "ordinal", "path", "value_json")
