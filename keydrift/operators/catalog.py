"""Reading catalogs of saved queries and notes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def newest_first(catalog: DataFrame, cap: int | None = None) -> DataFrame:
    """Latest ``create_at`` first, rows without one before all others, ``id`` breaking ties; all of
    them, or the first ``cap``."""
    ordered = catalog.orderBy(F.col("create_at").desc_nulls_first(), F.col("id"))
    return ordered if cap is None else ordered.limit(cap)


def contains_text(columns: tuple[str, ...], term: str) -> Column:
    """Any column contains the term, literally and ignoring case; an empty term matches all."""
    wanted = F.lower(F.lit(term))
    hits = [F.contains(F.lower(F.col(name)), wanted) for name in columns]
    return reduce(lambda a, b: a | b, hits)


def matches_facet(column: str, term: str) -> Column:
    """The facet contains the term, ignoring case; an empty term matches all rows."""
    if term == "":
        return F.lit(True)
    found = F.contains(F.lower(F.col(column)), F.lower(F.lit(term)))
    return F.coalesce((F.col(column) != "") & found, F.lit(False))


def search_queries(
    queries: DataFrame, term: str = "", hospital: str = "", cap: int | None = None
) -> DataFrame:
    """Queries that match, newest first; with ``cap`` the search sees only that many newest rows."""
    return newest_first(queries, cap).where(
        contains_text(("title", "query"), term) & matches_facet("hos_use", hospital)
    )


def search_notes(notes: DataFrame, term: str = "", cap: int | None = None) -> DataFrame:
    return newest_first(notes, cap).where(contains_text(("note", "description"), term))


def facet_values(catalog: DataFrame, column: str = "hos_use") -> DataFrame:
    """Distinct non-empty values, ascending."""
    return catalog.select(column).where(F.col(column) != "").distinct().orderBy(column)


def row_counts(**catalogs: DataFrame) -> DataFrame:
    """Exact row count of every catalog, in one job: ``catalog, n_rows``."""
    counted = [
        frame.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("catalog"), "n_rows")
        for name, frame in catalogs.items()
    ]
    return reduce(DataFrame.unionByName, counted)
