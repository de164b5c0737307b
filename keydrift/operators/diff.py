"""Missing-key comparison: which keys of the source document the target lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from keydrift.functions.once import built_once
from keydrift.functions.text import choose, let
from keydrift.functions.tree import (
    compact_json,
    is_object,
    key_text,
    levels,
    open_object,
    open_target,
    rank_of,
)
from keydrift.operators.validate import error_of, has_shape, json_error, valid_marks
from keydrift.plans.session import require_settings

_NODES = "array<struct<ordinal:array<bigint>,path:array<string>,source:string,target:string>>"


def missing_nodes(target: Column, source: Column) -> Column:
    """Topmost missing members of one marked pair, as an array in document order.

    Both documents are walked together, level by level, so a member whose parent is missing is
    never visited and a branch with equal text on both sides is not opened.
    """
    none = F.array().cast(_NODES)
    root = F.struct(
        F.array().cast("array<bigint>").alias("ordinal"),
        F.array().cast("array<string>").alias("path"),
        source.alias("source"),
        target.alias("target"),
    )
    start = F.struct(none.alias("found"), F.array(root).alias("open"))

    def next_level(state: Column, _: Column) -> Column:
        advanced = let(
            F.flatten(F.transform(state["open"], _missing_or_open)),
            lambda nodes: F.struct(
                F.flatten(F.array(state["found"], F.filter(nodes, _is_missing))).alias("found"),
                F.filter(nodes, lambda n: ~_is_missing(n)).alias("open"),
            ),
        )
        return choose(F.size(state["open"]) == 0, state, advanced)

    return F.sort_array(F.aggregate(levels(source), start, next_level)["found"])


def _is_missing(node: Column) -> Column:
    return node["target"].isNull()


def _missing_or_open(node: Column) -> Column:
    """Members of a source object that the target lacks, or that both sides must open."""

    def named(key: Column, position: Column, sides: Column) -> Column:
        return F.struct(
            F.flatten(F.array(node["ordinal"], rank_of(key, position))).alias("ordinal"),
            F.array_append(node["path"], key).alias("path"),
            sides["source"].alias("source"),
            sides["target"].alias("target"),
        )

    members = F.transform(
        F.map_entries(_kept_sides(node)),
        lambda e, position: F.when(e["value"].isNotNull(), named(key_text(e["key"]), position, e["value"])),
    )
    return F.filter(members, lambda m: m.isNotNull())


def _kept_sides(node: Column) -> Column:
    """Both sides of every member of a source object that the target lacks or that must be opened, NULL for the others.

    The members come in the source's order, the target's own behind them.
    """
    return F.map_zip_with(
        open_object(node["source"]),
        open_target(node["target"]),
        lambda _, source, target: F.when(
            source.isNotNull() & (target.isNull() | (is_object(source) & (source != target))),
            F.struct(source.alias("source"), target.alias("target")),
        ),
    )


def missing_count(target: Column, source: Column) -> Column:
    """How many nodes :func:`missing_nodes` has, counted on the way without places and paths."""
    root = F.struct(source.alias("source"), target.alias("target"))
    start = F.struct(F.lit(0).alias("found"), F.array(root).alias("open"))

    def next_level(state: Column, _: Column) -> Column:
        inside = F.transform(
            state["open"], lambda node: F.filter(F.map_values(_kept_sides(node)), lambda m: m.isNotNull())
        )
        advanced = let(
            F.flatten(inside),
            lambda nodes: let(
                F.filter(nodes, lambda n: ~_is_missing(n)),
                lambda deeper: F.struct(
                    (state["found"] + F.size(nodes) - F.size(deeper)).alias("found"), deeper.alias("open")
                ),
            ),
        )
        return choose(F.size(state["open"]) == 0, state, advanced)

    return F.aggregate(levels(source), start, next_level)["found"]


def marked_pairs(pairs: DataFrame, keep: tuple[str, ...], gate: Column | None = None) -> DataFrame:
    """``keep…, target, source, status``: marked sides of the pairs that can be walked, NULL for the others.

    Each side is parsed once. ``status`` names the fault of a side that could not be read. Pairs that fail ``gate``
    have no marks, but a status; they are parsed for it alone, so not at all where nobody asks for it.
    """
    # Gated by columns, not by a filter: a filter on the texts would be pushed below the step
    # that builds them and build them once more for every mention.
    target, source = F.col("target_json"), F.col("source_json")
    shaped = has_shape(target, source) if gate is None else has_shape(target, source) & gate
    needed = list(dict.fromkeys([*keep, "target_json", "source_json"]))
    read = pairs.select(
        *needed,
        shaped.alias("_shaped"),
        F.when(shaped, valid_marks(target)).alias("_target"),
        F.when(shaped, valid_marks(source)).alias("_source"),
    )
    ready = F.col("_target").isNotNull() & F.col("_source").isNotNull()
    read_error = F.coalesce(error_of(target, F.col("_target")), error_of(source, F.col("_source")))
    return read.select(
        *keep,
        F.when(ready, F.col("_target")).alias("target"),
        F.when(ready, F.col("_source")).alias("source"),
        F.when(F.col("_shaped"), read_error).otherwise(F.coalesce(json_error(target), json_error(source))).alias("status"),
    )


def _walked(pairs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``keep…, missing, status``: the missing nodes of each pair, NULL where it cannot be compared."""
    require_settings(pairs.sparkSession)
    nodes = built_once(
        "missing_nodes", lambda: missing_nodes(F.col("target"), F.col("source"))
    )
    return marked_pairs(pairs, keep).select(
        *keep, F.when(F.col("target").isNotNull(), nodes).alias("missing"), "status"
    )


def missing_keys(pairs: DataFrame, keep: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """``pairs`` → one row per missing key: ``keep…, seq, ordinal, path, value_json``.

    Narrow: works on batches and streams, needs no shuffle and no unique key. ``seq`` is the
    row's place within its pair.
    """
    # The outer form, because Spark evaluates the walk again to skip empty arrays otherwise.
    nodes = _walked(pairs, keep).select(
        *keep, F.posexplode_outer("missing").alias("seq", "node")
    )
    value = built_once("compact source", lambda: compact_json(F.col("node.source")))
    return nodes.where("seq IS NOT NULL").select(
        *keep,
        "seq",
        F.col("node.ordinal").alias("ordinal"),
        F.col("node.path").alias("path"),
        value.alias("value_json"),
    )


def missing_counts(pairs: DataFrame, keep: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """Number of missing keys per pair, zero included: ``keep…, n_missing, status``. Narrow as well.

    ``status`` names the fault of a side that could not be read, whose pair has no count but zero.
    """
    require_settings(pairs.sparkSession)
    counted = built_once("missing_count", lambda: missing_count(F.col("target"), F.col("source")))
    found = F.when(F.col("target").isNotNull(), counted).otherwise(0)
    return marked_pairs(pairs, keep).select(*keep, found.cast("bigint").alias("n_missing"), "status")
