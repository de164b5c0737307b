"""Comparison with stored documents by branch digests: only branches that changed are opened.

A stored document is parsed once, into a tree of digests. A digest covers a whole branch in canonical form, so that
spacing and the order of keys don't matter. A new document is walked against the tree: a branch with the stored
digest lacks nothing and stays closed with all that lies below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from keydrift.functions.once import built_once
from keydrift.functions.text import let
from keydrift.functions.tree import compact_json, is_array, is_object, key_text, levels, marked, open_object, open_target, rank_of
from keydrift.operators.validate import can_walk, has_members, is_valid_json
from keydrift.plans.session import require_settings

_TREE = "map<string,struct<digest:string,keys:array<string>>>"
_OPEN = "array<struct<path:array<string>,value:string>>"
_BRANCHES = "array<struct<path:string,digest:string,keys:array<string>>>"
_NODES = "array<struct<ordinal:array<bigint>,path:array<string>,source:string,missing:boolean>>"


def branch_digest(value: Column) -> Column:
    """Digest of a marked value in canonical form (keys sorted); NULL where it has none, and then it is opened."""
    return F.sha2(F.to_json(F.try_parse_json(value)), 256)


def _name(path: Column) -> Column:
    return F.to_json(path)


def _tree(document: Column) -> Column:
    """path → digest and keys of every value of a marked document; scalars have neither."""
    root = F.struct(F.array().cast("array<string>").alias("path"), document.alias("value"))
    start = F.struct(F.array().cast(_BRANCHES).alias("found"), F.array(root).cast(_OPEN).alias("open"))

    def branch(node: Column) -> Column:
        """The node's branch, and its members to be opened next; both from opening it once."""

        def of(members: Column) -> Column:
            below = F.transform(
                members,
                lambda e: F.struct(F.array_append(node["path"], key_text(e["key"])).alias("path"), e["value"].alias("value")),
            )
            digest = F.when(is_object(node["value"]), branch_digest(node["value"]))
            keys = F.transform(members, lambda e: key_text(e["key"]))
            own = F.struct(_name(node["path"]).alias("path"), digest.alias("digest"), keys.alias("keys"))
            return F.struct(own.alias("own"), below.alias("below"))

        return let(F.map_entries(open_target(node["value"])), of)

    def next_level(state: Column, _: Column) -> Column:
        return let(
            F.transform(state["open"], branch),
            lambda branches: F.struct(
                F.flatten(F.array(state["found"], F.transform(branches, lambda b: b["own"]))).alias("found"),
                F.flatten(F.transform(branches, lambda b: b["below"])).alias("open"),
            ),
        )

    # Scalars have a branch too, so there is a round for those of the last level.
    rounds = F.array_append(levels(document), F.lit(0))
    branches = F.aggregate(rounds, start, next_level)["found"]
    return F.map_from_entries(F.transform(branches, lambda b: F.struct(b["path"].alias("key"), F.struct(b["digest"].alias("digest"), b["keys"].alias("keys")).alias("value"))))


def digest_trees(documents: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """``keep…, tree`` of every document, to be stored beside it; NULL for one that is no JSON object or array.

    The tree has an entry for each of the document's values, so a row stays within a small multiple of its document.
    """
    require_settings(documents.sparkSession)
    checked = documents.select(*keep, text, is_valid_json(F.col(text)).alias("_valid"))
    opened = checked.select(*keep, F.when(F.col("_valid"), marked(F.col(text))).alias("_document"))
    whole = is_object(F.col("_document")) | is_array(F.col("_document"))
    tree = built_once("digest tree", lambda: _tree(F.col("_document")))
    return opened.select(*keep, F.when(whole, tree).cast(_TREE).alias("tree"))


def _missing(tree: Column, source: Column) -> Column:
    """Topmost missing members of a marked source, and how many of its objects were opened."""
    none = F.array().cast(_NODES)
    path = F.array().cast("array<string>")
    root = F.struct(F.array().cast("array<bigint>").alias("ordinal"), path.alias("path"), source.alias("source"), F.lit(False).alias("missing"))
    same = F.coalesce(branch_digest(source) == F.element_at(tree, _name(path))["digest"], F.lit(False))
    start = F.struct(none.alias("found"), F.when(same, none).otherwise(F.array(root).cast(_NODES)).alias("open"), F.lit(0).alias("opened"))

    def children(node: Column) -> Column:
        def kept(stored: Column) -> Column:
            members = F.transform(
                F.map_entries(open_object(node["source"])),
                lambda e, i: F.struct(
                    F.flatten(F.array(node["ordinal"], rank_of(key_text(e["key"]), i))).alias("ordinal"),
                    F.array_append(node["path"], key_text(e["key"])).alias("path"),
                    e["value"].alias("source"),
                    (~F.array_contains(stored, key_text(e["key"]))).alias("missing"),
                ),
            )
            return F.filter(members, lambda m: m["missing"] | (is_object(m["source"]) & ~_unchanged(m)))

        return let(F.element_at(tree, _name(node["path"]))["keys"], kept)

    def _unchanged(member: Column) -> Column:
        return F.coalesce(branch_digest(member["source"]) == F.element_at(tree, _name(member["path"]))["digest"], F.lit(False))

    def next_level(state: Column, _: Column) -> Column:
        advanced = let(
            F.flatten(F.transform(state["open"], children)),
            lambda nodes: F.struct(
                F.flatten(F.array(state["found"], F.filter(nodes, lambda n: n["missing"]))).alias("found"),
                F.filter(nodes, lambda n: ~n["missing"]).alias("open"),
                (state["opened"] + F.size(state["open"])).alias("opened"),
            ),
        )
        return F.when(F.size(state["open"]) == 0, state).otherwise(advanced)

    walked = F.aggregate(levels(source), start, next_level)
    return let(walked, lambda w: F.struct(F.array_sort(w["found"]).alias("found"), w["opened"].alias("opened")))


def _walked(sources: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    require_settings(sources.sparkSession)
    # A source is compared with a stored object or array; the stand-in for it is any object that can be walked.
    walkable = F.col("tree").isNotNull() & can_walk(F.lit('{"stored":0}'), F.col("source_json")) & has_members(F.col("source_json"))
    checked = sources.select(*keep, "tree", "source_json", walkable.alias("_walkable"))
    ready = checked.select(*keep, "tree", F.when(F.col("_walkable"), marked(F.col("source_json"))).alias("_source"))
    found = built_once("missing by digests", lambda: _missing(F.col("tree"), F.col("_source")))
    return ready.select(*keep, F.when(F.col("_source").isNotNull(), found).alias("_walk"))


def missing_by_digests(sources: DataFrame, keep: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """``keep…, source_json, tree`` → the rows of ``missing_keys`` against the document that the tree was made of.

    Narrow: the tree comes by a lookup join of the caller, once per document, and the stored text is never read.
    """
    nodes = _walked(sources, keep).select(*keep, F.posexplode_outer("_walk.found").alias("seq", "node"))
    value = built_once("compact changed", lambda: compact_json(F.col("node.source")))
    return nodes.where("seq IS NOT NULL").select(
        *keep, "seq", F.col("node.ordinal").alias("ordinal"), F.col("node.path").alias("path"), value.alias("value_json")
    )


def opened_counts(sources: DataFrame, keep: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """How many objects of each document had to be opened: ``keep…, n_opened``; none where its root has the stored digest."""
    return _walked(sources, keep).select(*keep, F.coalesce("_walk.opened", F.lit(0)).cast("bigint").alias("n_opened"))
