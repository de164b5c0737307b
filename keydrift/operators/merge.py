"""Import of missing keys into the target, in the source's key order, and printing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from keydrift.functions.once import built_once
from keydrift.functions.tree import compact_json, rendered_lines
from keydrift.operators.diff import marked_pairs, missing_keys
from keydrift.plans.session import require_settings

#: Chosen paths of one pair that are gathered as they come; of pairs with more, those of missing keys alone.
GATHERED = 1_000
_HITS = "array<struct<path:array<string>,line_no:int,source:string>>"


def import_all(pairs: DataFrame, keep: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """Every missing key taken over: ``keep…, merged_json, n_imported, import_lines, status``.

    A pair without missing keys, or with a side that cannot be compared, keeps its target text
    unchanged. ``import_lines`` lists path, exact line and marked value of each imported key;
    :func:`imported_keys` makes rows of them. ``status`` tells a side that could not be read.
    """
    return _merged(pairs, keep, None)


def import_selected(
    pairs: DataFrame,
    selection: DataFrame,
    key: str = "pair_id",
    keep: tuple[str, ...] = ("pair_id",),
) -> DataFrame:
    """Only the selected missing keys taken over; ``selection`` has ``key`` and ``path``.

    A path that is no missing key of its pair has no effect. Where a pair has many paths, such ones are dropped
    before its paths are gathered into its row; so they are bounded by ``GATHERED`` or the keys of one document.
    Pairs without a selected path are not walked.
    """
    selection = selection.select(key, "path").where(~F.exists("path", lambda k: k.isNull())).distinct()
    many = selection.groupBy(key).count().where(F.col("count") > GATHERED).select(key)
    few = selection.join(many, key, "left_anti")
    asked = pairs.join(many, key, "left_semi")
    known = missing_keys(asked, keep=(key,)).select(key, "path")
    rest = selection.join(many, key, "left_semi").join(known, [key, "path"], "left_semi")
    picked = few.unionByName(rest).groupBy(key).agg(F.collect_list("path").alias("picked"))
    none = F.array().cast("array<array<string>>")
    chosen = pairs.join(picked, key, "left").withColumn("picked", F.coalesce("picked", none))
    return _merged(chosen, keep, "picked")


def imported_keys(merged: DataFrame, keep: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """What an import took over, in printed order: ``keep…, seq, path, line_no, value_json``."""
    hits = merged.select(*keep, F.posexplode_outer("import_lines").alias("seq", "hit"))
    value = built_once("compact import", lambda: compact_json(F.col("hit.source")))
    return hits.where("seq IS NOT NULL").select(
        *keep, "seq", F.col("hit.path").alias("path"), F.col("hit.line_no").alias("line_no"), value.alias("value_json")
    )


def _merged(pairs: DataFrame, keep: tuple[str, ...], picked: str | None) -> DataFrame:
    require_settings(pairs.sparkSession)
    # Pairs that cannot be compared, or import nothing, carry NULL marks: they are printed as they came.
    carried = tuple(dict.fromkeys([*keep, "target_json", *([picked] if picked else [])]))
    ready = marked_pairs(pairs, carried, F.size(picked) > 0 if picked else None)
    lines = built_once(
        f"rendered_lines {picked}",
        lambda: rendered_lines(
            F.col("target"), F.col("source"), F.col(picked) if picked else None
        ),
    )
    printed = ready.select(
        *keep, "target_json", "status", F.when(F.col("target").isNotNull(), lines).alias("lines")
    )
    numbered = F.transform(
        "lines",
        lambda line, position: F.when(
            line["hit"],
            F.struct(
                line["path"].alias("path"), (position + 1).alias("line_no"), line["source"].alias("source")
            ),
        ),
    )
    hits = F.filter(numbered, lambda n: n.isNotNull())
    located = printed.select(
        *keep,
        "target_json",
        "status",
        "lines",
        F.coalesce(hits, F.array().cast(_HITS)).alias("import_lines"),
    )
    changed = F.size("import_lines") > 0
    text = F.array_join(F.transform("lines", lambda line: line["text"]), "\n")
    return located.select(
        *keep,
        F.when(changed, text).otherwise(F.col("target_json")).alias("merged_json"),
        F.size("import_lines").alias("n_imported"),
        "import_lines",
        "status",
    )
