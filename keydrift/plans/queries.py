"""Every operator as a query over whole tables of a data folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from keydrift.functions.text import display_path, is_blank
from keydrift.operators import catalog, changes, grams, history, lines, members, pages, tallies, tombstones, users, versions
from keydrift.operators.diff import missing_counts, missing_keys
from keydrift.operators.merge import import_all, import_selected
from keydrift.operators.validate import is_valid_json, json_error, with_status
from keydrift.plans import workload as w
from keydrift.sources.shared import new_folder, stored
from keydrift.streaming import heavy, logins
from keydrift.streaming.streams import missing_against_baselines


def shown_path():
    return display_path(F.col("path")).alias("path")


def shown_ordinal():
    return F.array_join(F.col("ordinal").cast("array<string>"), ".").alias("ordinal")


def big_of(column):
    return column.cast("bigint")


def big(name: str):
    return F.col(name).cast("bigint").alias(name)


def diff_missing_keys(spark, folder) -> DataFrame:
    found = missing_keys(w.config_pairs(spark, folder))
    return found.select("pair_id", big("seq"), shown_ordinal(), shown_path(), "value_json")


def diff_counts(spark, folder) -> DataFrame:
    return missing_counts(w.config_pairs(spark, folder)).drop("status")


def diff_same_document(spark, folder) -> DataFrame:
    pairs = w.config_pairs(spark, folder)
    same = pairs.selectExpr("pair_id", "source_json AS target_json", "source_json")
    return missing_counts(same).drop("status")


def diff_source_members(spark, folder) -> DataFrame:
    found = members.source_members(w.config_pairs(spark, folder), "source_json")
    return found.select("pair_id", shown_ordinal(), shown_path(), "kind", "value_json")


def diff_target_paths(spark, folder) -> DataFrame:
    found = members.target_paths(w.config_pairs(spark, folder), "target_json")
    return found.select("pair_id", shown_path())


def diff_by_join(spark, folder) -> DataFrame:
    pairs = w.config_pairs(spark, folder)
    found = members.missing_members(
        members.source_members(pairs, "source_json"), members.target_paths(pairs, "target_json")
    )
    return found.select("pair_id", shown_ordinal(), shown_path(), "value_json")


def diff_against_baselines(spark, folder) -> DataFrame:
    found = missing_against_baselines(
        w.baseline_sources(spark, folder), w.baselines(spark, folder)
    )
    return found.select("pair_id", big("seq"), shown_path(), "value_json")


def diff_hot_baseline(spark, folder) -> DataFrame:
    """Nine of ten documents refer to one baseline, which the sketch finds."""
    sources = w.baseline_sources(spark, folder)
    sources = sources.withColumn("baseline_id", F.when(F.col("pair_id") % 10 < 9, "BUILDING").otherwise(F.col("baseline_id")))
    found = heavy.missing_against_hot_baselines(sources, w.baselines(spark, folder))
    return found.select("pair_id", big("seq"), shown_path(), "value_json")


def diff_shared_baseline(spark, folder) -> DataFrame:
    sources, keys = w.baseline_sources(spark, folder), ("pair_id", "baseline_id")
    asked = members.source_members(sources, "source_json", keys)
    given = members.target_paths(w.baselines(spark, folder), "target_json", ("baseline_id",))
    return members.missing_shared(asked, given).select("pair_id", "baseline_id", shown_path(), "value_json")


def _stored(pairs: DataFrame) -> DataFrame:
    """Sources with the digest trees of their targets."""
    trees = versions.digest_trees(pairs, "target_json", ("pair_id",))
    return pairs.select("pair_id", "source_json").join(trees, "pair_id")


def diff_by_digests(spark, folder) -> DataFrame:
    found = versions.missing_by_digests(_stored(w.config_pairs(spark, folder)))
    return found.select("pair_id", big("seq"), shown_ordinal(), shown_path(), "value_json")


def diff_opened(spark, folder) -> DataFrame:
    """Objects opened where every other stored document is the new one with its keys in another order."""
    pairs = w.config_pairs(spark, folder)
    turned = F.expr("replace(source_json, '{\"min\":1,\"max\":' || (pair_id % 50) || '}', '{ \"max\" : ' || (pair_id % 50) || ', \"min\":1}')")
    same = pairs.withColumn("target_json", F.when(F.col("pair_id") % 2 == 0, turned).otherwise(F.lit('{"key":0,"db":{"pool":{}}}')))
    return versions.opened_counts(_stored(same))


def hard_by_digests(spark, folder) -> DataFrame:
    found = versions.missing_by_digests(_stored(w.hard_pairs(spark, folder)))
    return found.select("pair_id", big("seq"), shown_path(), "value_json")


def merge_import_all(spark, folder) -> DataFrame:
    merged = import_all(w.config_pairs(spark, folder))
    return merged.select("pair_id", "merged_json", big("n_imported"))


def merge_import_selected(spark, folder) -> DataFrame:
    merged = import_selected(w.config_pairs(spark, folder), w.import_choice(spark, folder))
    return merged.select("pair_id", "merged_json", big("n_imported"))


def merge_leaves_nothing(spark, folder) -> DataFrame:
    pairs = w.config_pairs(spark, folder)
    merged = import_all(pairs, keep=("pair_id", "source_json")).selectExpr(
        "pair_id", "merged_json AS target_json", "source_json"
    )
    return missing_counts(merged).drop("status")


def lines_numbered(spark, folder) -> DataFrame:
    documents = w.table(spark, folder, "documents")
    found = lines.numbered_lines(documents, "text", keep=("doc_id",))
    return found.select("doc_id", big("line_no"), "line")


def lines_exact(spark, folder) -> DataFrame:
    exact = lines.exact_lines(import_all(w.config_pairs(spark, folder)))
    return exact.select("pair_id", shown_path(), big("line_no"))


def lines_first_match(spark, folder) -> DataFrame:
    located = lines.located_lines(import_all(w.config_pairs(spark, folder)))
    found = located.select("pair_id", F.explode_outer("located").alias("hit"))
    return found.where("hit IS NOT NULL").select(
        "pair_id",
        display_path(F.col("hit.path")).alias("path"),
        F.col("hit.line_no").cast("bigint").alias("line_no"),
    )


def lines_highlighted(spark, folder) -> DataFrame:
    marked = lines.highlights(import_all(w.config_pairs(spark, folder)))
    return marked.select(
        "pair_id", F.array_join(F.col("line_nos").cast("array<string>"), ",").alias("line_nos")
    )


def _history(spark, folder, kind=history.ALL, condition="true", pairs=None) -> DataFrame:
    # Ordered before the walk, which keeps the order: sorting its rows would walk every pair twice.
    pairs = w.config_pairs(spark, folder, in_order=True) if pairs is None else pairs.orderBy("pair_id")
    found = missing_keys(pairs).where(condition)
    at = F.to_timestamp(F.lit("2024-05-01 00:00:00"))
    return history.history_rows(found, kind, at)


def _shown_history(rows) -> DataFrame:
    return history.with_label(rows).select("pair_id", "ts", big("batch_seq"), shown_path(), "value_json", "type", "label")


def history_rows(spark, folder) -> DataFrame:
    return _shown_history(_history(spark, folder))


def history_single(spark, folder) -> DataFrame:
    return _shown_history(_history(spark, folder, history.SINGLE, "seq = 0"))


def history_selected(spark, folder) -> DataFrame:
    merged = import_selected(w.config_pairs(spark, folder), w.import_choice(spark, folder))
    at = F.to_timestamp(F.lit("2024-05-01 00:00:00"))
    return _shown_history(history.import_history(merged, history.SINGLE, at))


def hard_missing_keys(spark, folder) -> DataFrame:
    return missing_keys(w.hard_pairs(spark, folder)).select("pair_id", big("seq"), shown_path(), "value_json")


def hard_counts(spark, folder) -> DataFrame:
    return missing_counts(w.hard_pairs(spark, folder))


def hard_import_all(spark, folder) -> DataFrame:
    merged = import_all(w.hard_pairs(spark, folder))
    return merged.select("pair_id", "merged_json", big("n_imported"), "status")


def hard_status(spark, folder) -> DataFrame:
    return with_status(w.hard_pairs(spark, folder)).select("pair_id", "target_error", "source_error", "comparable", "error")


def history_cleared(spark, folder) -> DataFrame:
    cleared = w.table(spark, folder, "orders").where("o_orderstatus = 'F'")
    # Cleared pairs go before they are walked, as an empty history needs no comparison.
    pairs = history.without_pairs(w.config_pairs(spark, folder), cleared.selectExpr("o_orderkey AS pair_id"))
    return _history(spark, folder, pairs=pairs).groupBy("type").agg(F.count("*").alias("n_rows"))


def history_tombstones(spark, folder) -> DataFrame:
    """A history whose pairs are cleared in two rounds, with rows in between, compacted after the first."""
    orders, store = w.table(spark, folder, "orders"), tombstones.HistoryStore(new_folder(spark, "history"), 8)
    rows = stored(_history(spark, folder), "imported")
    tombstones.begin_history(spark, store)
    tombstones.append_rows(rows.where("pair_id % 3 <> 0"), store)
    at = F.to_timestamp(F.lit("2024-05-01 12:00:00"))
    tombstones.clear_pairs(orders.where("o_orderstatus = 'F'").selectExpr("o_orderkey AS pair_id"), store, at)
    tombstones.compact(spark, store)
    later = rows.where("pair_id % 3 = 0").withColumn("ts", F.to_timestamp(F.lit("2024-05-02 00:00:00")))
    tombstones.append_rows(later, store)
    tombstones.clear_pairs(
        orders.where("o_orderkey % 10 = 0").selectExpr("o_orderkey AS pair_id"), store, F.to_timestamp(F.lit("2024-05-03 00:00:00"))
    )
    kept = tombstones.current_history(spark, store)
    return kept.select("pair_id", "ts", big("batch_seq"), shown_path(), "value_json")


def text_validity(spark, folder) -> DataFrame:
    text = F.col("text")
    return w.checked_texts(spark, folder).select(
        "origin",
        "id",
        is_blank(text).alias("blank"),
        is_valid_json(text).alias("valid"),
        json_error(text).alias("error"),
    )


def pair_status(spark, folder) -> DataFrame:
    events = w.table(spark, folder, "events").selectExpr(
        "event_id AS pair_id",
        """CASE event_id % 6 WHEN 0 THEN 'null' WHEN 1 THEN '0.0' WHEN 2 THEN '' WHEN 3 THEN '7'
           WHEN 4 THEN props || '}' ELSE props END AS target_json""",
        "CASE event_id % 4 WHEN 0 THEN ' ' WHEN 1 THEN '[1]' ELSE props END AS source_json",
    )
    return with_status(events).select(
        "pair_id", "target_error", "source_error", "comparable", "error"
    )


def catalog_newest_first(spark, folder) -> DataFrame:
    """The latest 1,000, as a listing of the latest n shows them."""
    newest = catalog.newest_first(w.event_queries(spark, folder), cap=1000)
    place = F.row_number().over(Window.orderBy(F.col("create_at").desc_nulls_first(), "id"))
    return newest.select("id", "title", "create_at", big_of(place).alias("place"))


def catalog_listing(spark, folder) -> DataFrame:
    return catalog.newest_first(w.event_queries(spark, folder)).select("id", "title", "create_at")


def catalog_search_empty_term(spark, folder) -> DataFrame:
    return catalog.search_queries(w.saved_queries(spark, folder)).select("id", "title", "hos_use")


def catalog_search_listed(spark, folder) -> DataFrame:
    found = catalog.search_queries(w.event_queries(spark, folder), "CLICK", "hos-1")
    return found.select("id", "title", "query", "hos_use")


def catalog_search_everything(spark, folder) -> DataFrame:
    found = catalog.search_queries(w.saved_queries(spark, folder), "THE ", "e", cap=None)
    return found.select("id", "title", "hos_use")


def catalog_search_literal(spark, folder) -> DataFrame:
    found = catalog.search_queries(w.saved_queries(spark, folder), "%", "", cap=None)
    return found.select("id", "title", "hos_use")


def catalog_search_notes(spark, folder) -> DataFrame:
    return catalog.search_notes(w.saved_notes(spark, folder), "User", cap=None).select("id", "note")


INDEXED_TERMS = ("the ", "GNU general public", "ver", "%", "\n", "no such words anywhere", "e")


def catalog_search_indexed(spark, folder) -> DataFrame:
    """Frequent, rare, short and absent terms, each answered from one index."""
    index = grams.write_index(w.saved_queries(spark, folder), ("title", "query"), new_folder(spark, "grams"))
    found = [
        grams.search_index(spark, index, term).select(F.lit(term).alias("term"), "id", "hos_use") for term in INDEXED_TERMS
    ]
    return reduce(DataFrame.unionByName, found)


def catalog_pages(spark, folder) -> DataFrame:
    """The first page, the one after it, and the first of rows that have a time."""
    rows, path = w.event_queries(spark, folder), new_folder(spark, "listing")
    pages.write_listing(rows, path)
    first = pages.page(spark, rows.schema, path, 100)
    last = first.orderBy(F.col("create_at").asc_nulls_last(), F.col("id").desc()).first()
    second = pages.page(spark, rows.schema, path, 100, (last.create_at, last.id))
    dated = pages.page(spark, rows.schema, path, 100, (None, "~"))
    shown = [p.select(F.lit(n).alias("page"), "id", "title", "create_at") for n, p in enumerate((first, second, dated))]
    return reduce(DataFrame.unionByName, shown)


def changes_tally(spark, folder) -> DataFrame:
    """Counts per description carried through three change sets, never recounted."""
    now, feed = w.note_snapshot(spark, folder), w.note_changes(spark, folder)
    top = feed.agg(F.max("seq")).first()[0] or 0
    counts = stored(tallies.tally(now, "description"), "counts")
    for k in range(3):
        part = feed.where((F.col("seq") > top * k // 3 - (k == 0)) & (F.col("seq") <= top * (k + 1) // 3))
        moved = tallies.tally_changes(now, part, changes.NOTE_FIELDS, "description")
        counts = stored(tallies.updated_tally(counts, moved), "counts")
        now = stored(changes.apply_changes(now, part, changes.NOTE_FIELDS), "notes")
    return counts


def catalog_facet_values(spark, folder) -> DataFrame:
    return catalog.facet_values(w.saved_queries(spark, folder))


def catalog_row_counts(spark, folder) -> DataFrame:
    return catalog.row_counts(
        queries=w.saved_queries(spark, folder), notes=w.saved_notes(spark, folder)
    )


def changes_checked(spark, folder) -> DataFrame:
    feed = w.note_changes(spark, folder)
    odd = feed.withColumn("op", F.expr("CASE seq % 23 WHEN 0 THEN NULL WHEN 1 THEN 'X' ELSE op END"))
    odd = odd.withColumn("seq", F.when(F.col("seq") % 29 != 5, F.col("seq")))
    return changes.checked_changes(odd, *changes.NOTE_RULE).select("seq", "op", "id", "reason")


def changes_insert_defaults(spark, folder) -> DataFrame:
    rows = w.table(spark, folder, "documents").selectExpr(
        "sha2(CAST(doc_id AS STRING), 256) AS id",
        "source AS title",
        "CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang END AS hos_use",
        "CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN lang END AS actor",
        "timestamp'2024-01-01 00:00:00' AS at",
    )
    return changes.with_insert_defaults(rows)


def changes_violations(spark, folder) -> DataFrame:
    stored = w.profiles(spark, folder).withColumn("email", F.nullif("email", F.lit("Customer#000000007")))
    return changes.violations(stored, not_null=("id", "email"), unique=("id", "email"))


def changes_applied(spark, folder) -> DataFrame:
    return changes.apply_changes(
        w.note_snapshot(spark, folder), w.note_changes(spark, folder), changes.NOTE_FIELDS
    )


def changes_tied(spark, folder) -> DataFrame:
    """Few ids with many changes of equal number, and changes without one."""
    feed = w.note_changes(spark, folder).selectExpr(
        "op", "CASE WHEN seq % 11 = 3 THEN NULL ELSE seq % 40 END AS seq", "CAST(seq % 30 AS STRING) AS id",
        "actor", "at", "note", "description",
    )
    return changes.apply_changes(w.note_snapshot(spark, folder), feed, changes.NOTE_FIELDS)


def changes_inserted_without_id(spark, folder) -> DataFrame:
    """Every insert without id becomes a row; updates and deletes without one do nothing."""
    feed = w.note_changes(spark, folder).withColumn("id", F.lit(None).cast("string"))
    applied = changes.apply_changes(w.note_snapshot(spark, folder).where("false"), feed, changes.NOTE_FIELDS)
    return applied.select("note", "description", "create_by", "create_at", (F.length("id") == 36).alias("has_id"))


def users_profiles(spark, folder) -> DataFrame:
    found = users.find_profiles(w.logins(spark, folder), w.profiles(spark, folder))
    return found.select("login_no", "id", "status", "profile_email", "role")


def users_provisioned(spark, folder) -> DataFrame:
    stored, _ = users.provision(w.profiles(spark, folder), w.logins(spark, folder))
    return stored.select("id", "email", "role", "create_by", "create_at")


def users_refused(spark, folder) -> DataFrame:
    return users.provision(w.profiles(spark, folder), w.logins(spark, folder))[1]


def _streamed_logins(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Two feeds that bring the same ids and emails, later logins first: each in batches, then both told together."""
    every, log = w.logins(spark, folder), new_folder(spark, "login-log")
    for feed, mine in (("web", "login_no % 3 = 0"), ("desk", "login_no % 3 <> 0")):
        arriving = new_folder(spark, "logins")
        late = every.where(mine).repartitionByRange(4, F.col("login_at").desc())
        late.write.parquet(arriving)
        stream = spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 2).parquet(arriving)
        writer = logins.login_log_writer(stream, log, feed, new_folder(spark, "login-state"))
        writer.trigger(availableNow=True).start().awaitTermination()
    return logins.provisioned(spark, w.profiles(spark, folder), log)


def users_streamed(spark, folder) -> DataFrame:
    return _streamed_logins(spark, folder)[0].select("id", "email", "role", "create_by", "create_at")


def users_streamed_refused(spark, folder) -> DataFrame:
    return _streamed_logins(spark, folder)[1]


def users_gate(spark, folder) -> DataFrame:
    requests = w.logins(spark, folder).selectExpr("login_no", "id AS actor")
    return users.gate(requests, w.profiles(spark, folder))


QUERIES = {
    f.__name__: f
    for f in (
        diff_missing_keys, diff_counts, diff_same_document, diff_source_members,
        diff_target_paths, diff_by_join, diff_against_baselines, diff_hot_baseline, diff_shared_baseline,
        diff_by_digests, diff_opened, hard_by_digests, merge_import_all,
        merge_import_selected, merge_leaves_nothing, lines_numbered, lines_exact,
        lines_first_match, lines_highlighted, history_rows, history_single, history_cleared, text_validity,
        pair_status, catalog_newest_first, catalog_search_listed, catalog_search_everything,
        catalog_search_literal, catalog_search_notes, catalog_facet_values, catalog_row_counts,
        changes_checked, changes_insert_defaults, changes_violations, changes_applied, changes_tied,
        users_profiles, users_provisioned, users_refused, users_streamed, users_streamed_refused, users_gate, history_selected, hard_missing_keys,
        hard_counts, hard_import_all, hard_status, catalog_listing, catalog_search_empty_term,
        changes_inserted_without_id, catalog_search_indexed, catalog_pages, changes_tally, history_tombstones,
    )
}
