"""Writing catalogs: checked changes applied to a snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from keydrift.functions.text import is_blank, none_if_empty

# Texts and defaults of the catalog forms.
QUERY_REQUIRED = "Title and Query fields are required."
NOTE_REQUIRED = "Title/Note and Description fields are required."
DEFAULT_ACTOR = "system"

UNKNOWN_OPERATION = "Unknown operation."
NO_SEQ = "A change needs a seq."

# What a saved query or note needs, and why it is rejected without.
QUERY_FIELDS = ("title", "query", "hos_use")
NOTE_FIELDS = ("note", "description")
QUERY_RULE = (("title", "query"), QUERY_REQUIRED)
NOTE_RULE = (NOTE_FIELDS, NOTE_REQUIRED)


def actor_or_default(actor: Column) -> Column:
    return F.coalesce(none_if_empty(actor), F.lit(DEFAULT_ACTOR))


def checked_changes(changes: DataFrame, required: tuple[str, ...], reason: str) -> DataFrame:
    """Changes with a ``reason`` to reject them, NULL for valid ones; split them at the sink.

    ``op`` must be I, U or D. An insert or update needs every required field non-blank; a delete
    needs none. Every change needs a ``seq``, without which it has no place among the others.
    """
    blank = reduce(lambda a, b: a | b, (is_blank(F.col(name)) for name in required))
    known = F.coalesce(F.col("op").isin("I", "U", "D"), F.lit(False))
    wrong = F.when(~known, UNKNOWN_OPERATION).when((F.col("op") != "D") & blank, reason)
    wrong = wrong.when(F.col("seq").isNull(), NO_SEQ)
    return changes.withColumn("reason", wrong)


def with_insert_defaults(rows: DataFrame, actor: str = "actor") -> DataFrame:
    """New catalog rows from form rows: id, creator, times; empty ``hos_use`` becomes NULL.

    An ``id`` or ``at`` column is used where present, which makes a retried task repeatable.
    """
    given = set(rows.columns)
    at = F.col("at") if "at" in given else F.current_timestamp()
    new_id = F.coalesce("id", F.uuid()) if "id" in given else F.uuid()
    fields = [c for c in rows.columns if c not in ("id", "at", actor)]
    values = [
        none_if_empty(F.col(c)).alias(c) if c == "hos_use" else F.col(c) for c in fields
    ]
    return rows.select(
        new_id.alias("id"),
        *values,
        actor_or_default(F.col(actor)).alias("create_by"),
        at.alias("create_at"),
        F.lit(None).cast("string").alias("update_by"),
        at.alias("update_at"),
    )


def violations(
    table: DataFrame,
    not_null: tuple[str, ...] = (),
    unique: tuple[str, ...] = ("id",),
) -> DataFrame:
    """Broken constraints: ``rule, column_name, key, n_rows``, one row per rule and value.

    All NOT NULL rules are one aggregation and all UNIQUE rules another.
    """
    rules = []
    if not_null:
        counts = table.agg(*(F.count_if(F.col(name).isNull()).alias(name) for name in not_null))
        each = F.array(*(F.struct(F.lit(n).alias("column_name"), F.col(n).alias("n_rows")) for n in not_null))
        rules.append(
            counts.select(F.inline(each)).where("n_rows > 0").select(
                F.lit("not null").alias("rule"), "column_name", F.lit(None).cast("string").alias("key"), "n_rows"
            )
        )
    if unique:
        each = F.array(
            *(F.struct(F.lit(n).alias("column_name"), F.col(n).cast("string").alias("key")) for n in unique)
        )
        rules.append(
            table.select(F.inline(each)).where("key IS NOT NULL").groupBy("column_name", "key")
            .agg(F.count("*").alias("n_rows")).where("n_rows > 1")
            .select(F.lit("unique").alias("rule"), "column_name", "key", "n_rows")
        )
    return reduce(DataFrame.unionByName, rules)


def admitted(
    stored: DataFrame,
    rows: DataFrame,
    order: tuple[str, ...],
    not_null: tuple[str, ...] = ("id",),
    unique: tuple[str, ...] = ("id",),
) -> DataFrame:
    """New rows with the ``reason`` that keeps them out of ``stored``, NULL for those to append.

    A NULL in ``not_null`` or a value that ``stored`` holds in a ``unique`` column refuses a row.
    Of new rows that share such a value the first in ``order`` is admitted; columns are taken in
    turn, so a row that is refused does not stand in another's way later.
    """
    missing = reduce(
        lambda a, b: F.coalesce(a, b), [F.when(F.col(n).isNull(), F.lit(f"not null: {n}")) for n in not_null]
    )
    rows = rows.withColumn("reason", missing)
    for name in unique:
        held = stored.select(F.col(name).alias("_held")).where("_held IS NOT NULL").distinct()
        place = F.struct(*order)
        first = (
            rows.where(F.col("reason").isNull() & F.col(name).isNotNull())
            .groupBy(F.col(name).alias("_value")).agg(F.min(place).alias("_first"))
        )
        taken = held.select(F.col("_held").alias("_value"), F.lit(True).alias("_taken"))
        known = first.join(taken, "_value", "left")
        joined = rows.join(known, rows[name] == known["_value"], "left")
        late = F.col("_taken").isNotNull() | (place != F.col("_first"))
        refused = F.when(F.col("reason").isNull() & F.col("_value").isNotNull() & late, F.lit(f"unique: {name}"))
        rows = joined.select(
            *[c for c in rows.columns if c != "reason"], F.coalesce("reason", refused).alias("reason")
        )
    return rows


def with_own_ids(changes: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Inserts without id get one made from their content, the same whenever they are read again."""
    digest = F.md5(F.to_json(F.struct("seq", "at", "actor", *fields), {"ignoreNullFields": "false"}))
    made = F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")
    return changes.withColumn("id", F.when(F.col("op") == "I", F.coalesce("id", made)).otherwise(F.col("id")))


def apply_changes(snapshot: DataFrame, changes: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """New snapshot after a change feed with ``op`` (I, U, D), ``seq``, ``id``, ``actor``, ``at``.

    Per id, in ``seq`` order: an insert creates the row unless it exists, an update sets all
    ``fields`` of an existing row and keeps its creation columns, a delete removes it. Changes to
    unknown ids, updates and deletes without id and unknown operations do nothing; an insert without
    id gets one. Changes without ``seq``, which :func:`checked_changes` refuses, do nothing. Of one
    id's changes with equal ``seq`` deletes come first, then inserts, then updates, each by their
    content (``at``, ``actor``, ``fields``; NULL first). Instead of replaying a hot id's changes in one task, its last delete is found first,
    then the first insert and the last update after that; both aggregations combine before the
    shuffle, and a hot id is the large side of a plain join, which adaptive execution splits.
    """
    values = [
        none_if_empty(F.col(name)).alias(name) if name == "hos_use" else F.col(name)
        for name in fields
    ]
    events = with_own_ids(changes, fields).where("id IS NOT NULL AND seq IS NOT NULL").select(
        "op", "seq", "id", "at", actor_or_default(F.col("actor")).alias("actor"), *values
    )
    row = F.struct("seq", "at", "actor", *fields)
    deletes = events.where("op = 'D'").groupBy("id").agg(F.max("seq").alias("deleted"))
    after = events.where("op <> 'D'").join(deletes, "id", "left").where("deleted IS NULL OR seq >= deleted")
    living = after.groupBy("id").agg(
        F.min(F.when(F.col("op") == "I", row)).alias("insert"),
        F.max(F.when(F.col("op") == "U", row)).alias("last_update"),
    )
    summary = deletes.join(living, "id", "full")

    old_names = [c for c in snapshot.columns if c != "id"]
    old = snapshot.select("id", F.struct(*old_names).alias("old"))
    both = old.join(summary, "id", "full")
    survives = F.col("old").isNotNull() & F.col("deleted").isNull()
    created = F.when(~survives, F.col("insert"))
    began = F.when(survives, F.lit(None)).otherwise(created["seq"])
    update = F.when(
        F.col("last_update").isNotNull()
        & (survives | (F.col("last_update.seq") >= began)),
        F.col("last_update"),
    )
    settled = both.where(survives | F.col("insert").isNotNull()).select(
        "id", "old", survives.alias("kept"), created.alias("made"), update.alias("upd")
    )

    def chosen(name: str) -> Column:
        updated, made, kept = F.col("upd"), F.col("made"), F.col("kept")
        if name in fields:
            before = F.when(kept, F.col(f"old.{name}")).otherwise(made[name])
            return F.when(updated.isNotNull(), updated[name]).otherwise(before)
        before = {
            "create_by": made["actor"],
            "create_at": made["at"],
            "update_at": made["at"],
        }.get(name, F.lit(None))
        before = F.when(kept, F.col(f"old.{name}")).otherwise(before)
        after = {"update_by": updated["actor"], "update_at": updated["at"]}.get(name)
        return before if after is None else F.when(updated.isNotNull(), after).otherwise(before)

    return settled.select("id", *(chosen(name).alias(name) for name in old_names))
