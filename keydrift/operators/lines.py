"""Where imported keys sit in the printed document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from keydrift.functions.once import built_once
from keydrift.functions.text import let, trimmed
from keydrift.plans.session import require_settings


def numbered_lines(
    documents: DataFrame, text: str = "merged_json", keep: tuple[str, ...] = ("pair_id",)
) -> DataFrame:
    """One row per line: ``keep…, line_no, line`` (from 1)."""
    # Outer forms here and below: the plain ones add a filter that builds the text once more.
    split = documents.select(
        *keep, F.posexplode_outer(F.split(text, "\n")).alias("pos", "line")
    )
    return split.where("pos IS NOT NULL").select(*keep, (F.col("pos") + 1).alias("line_no"), "line")


def exact_lines(merged: DataFrame, keep: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """Exact line of each imported path, known from printing: ``keep…, path, line_no``."""
    hits = merged.select(*keep, F.explode_outer("import_lines").alias("hit"))
    return hits.where("hit IS NOT NULL").select(
        *keep, F.col("hit.path").alias("path"), F.col("hit.line_no").alias("line_no")
    )


def located_lines(merged: DataFrame, keep: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """First line that starts with an imported path's last key in quotes, inside each row.

    Only the last segment counts, and as it stands, without JSON escapes. A line starts with
    ``"k"`` when its text up to the second quote is that; only for a key that itself holds a quote
    are a line's longer beginnings looked at, and both are matched by hash. ``merged`` comes from
    an import; the result has ``keep…, located`` with one ``struct<path, line_no>`` per matched path.
    """
    require_settings(merged.sparkSession)
    located = built_once("located_lines", _located)
    return merged.select(*keep, located.alias("located"))


def highlights(merged: DataFrame, keep: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """Distinct matched line numbers of each import, ascending: ``keep…, line_nos``."""
    numbers = F.transform("located", lambda hit: hit["line_no"])
    return located_lines(merged, keep).select(
        *keep, F.array_sort(F.array_distinct(numbers)).alias("line_nos")
    )


def _located() -> Column:
    shown = F.transform(
        F.split("merged_json", "\n"),
        lambda line, position: F.struct(
            trimmed(line).alias("text"), (position + 1).alias("line_no")
        ),
    )
    return let(
        F.filter(shown, lambda line: F.startswith(line["text"], F.lit('"'))), _match_paths
    )


def _match_paths(shown: Column) -> Column:
    """Keep the first line of every head, then give each path the line of its key."""
    backwards = F.reverse(
        F.transform(
            shown,
            lambda line: F.struct(
                F.regexp_extract(line["text"], '^"([^"]*+)"', 1).alias("head"),
                line["line_no"].alias("line_no"),
            ),
        )
    )
    keys = F.array_distinct(
        F.transform("import_lines", lambda hit: F.element_at(hit["path"], -1))
    )
    wanted = F.map_zip_with(
        F.map_from_arrays(keys, keys),
        F.map_from_entries(backwards),
        lambda _, key, line_no: F.when(key.isNotNull(), line_no),
    )
    found = F.map_filter(wanted, lambda _, line_no: line_no.isNotNull())

    has_quote = lambda key: F.contains(key, F.lit('"'))
    odd = F.transform(F.filter(keys, has_quote), lambda key: F.concat(F.lit('"'), key, F.lit('"')))
    longest = F.coalesce(F.array_max(F.transform(odd, F.length)), F.lit(0))

    def beginnings(line: Column, longest: Column) -> Column:
        """The line's texts up to its third and later quotes, as far as the longest odd key goes."""
        near = F.substring(line["text"], F.lit(1), longest)
        quotes = F.length(near) - F.length(F.replace(near, F.lit('"'), F.lit("")))
        ends = F.filter(F.sequence(F.lit(2), F.greatest(quotes, F.lit(2))), lambda n: (n > 2) & (n <= quotes))
        return F.transform(
            ends,
            lambda n: F.struct(
                F.concat(F.call_function("substring_index", near, F.lit('"'), n), F.lit('"')).alias("head"), line["line_no"].alias("line_no")
            ),
        )

    every = let(
        longest,
        lambda most: F.flatten(F.transform(F.reverse(shown), lambda line: beginnings(line, most))),
    )
    later = F.when(F.size(odd) > 0, every).otherwise(F.array().cast("array<struct<head:string,line_no:int>>"))
    wanted_odd = F.map_zip_with(
        F.map_from_arrays(odd, odd),
        F.map_from_entries(later),
        lambda _, key, line_no: F.when(key.isNotNull(), line_no),
    )
    found_odd = F.map_filter(wanted_odd, lambda _, line_no: line_no.isNotNull())
    both = F.struct(found.alias("plain"), found_odd.alias("odd"))

    def line_of(lines: Column, key: Column) -> Column:
        return F.when(has_quote(key), lines["odd"][F.concat(F.lit('"'), key, F.lit('"'))]).otherwise(lines["plain"][key])

    return let(
        both,
        lambda lines_by_key: F.filter(
            F.transform(
                F.col("import_lines"),
                lambda hit: F.struct(
                    hit["path"].alias("path"),
                    line_of(lines_by_key, F.element_at(hit["path"], -1)).alias("line_no"),
                ),
            ),
            lambda hit: hit["line_no"].isNotNull(),
        ),
    )
