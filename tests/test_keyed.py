import random
from datetime import datetime

import pytest

from keydrift.operators.changes import NOTE_FIELDS, NOTE_RULE, NO_SEQ, apply_changes, checked_changes
from keydrift.sources.schemas import NOTES, changes_schema
from keydrift.streaming.keyed import keyed_catalog, keyed_catalog_writer

SCHEMA = changes_schema(*NOTE_FIELDS)


def stored(spark, n):
    rows = [(str(i), f"base {i}", "d", "system", datetime(2023, 1, 1), None, datetime(2023, 1, 1)) for i in range(n)]
    return spark.createDataFrame(rows, NOTES)


def random_changes(seed, n, ids, hot=0.3):
    """Changes with equal, missing and scattered numbers; one id holds a large share of them."""
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        key = "0" if draw.random() < hot else draw.choice([str(draw.randrange(ids)), f"n{draw.randrange(ids)}", None])
        seq = None if draw.random() < 0.05 else draw.randrange(n // 3)
        at = datetime(2024, 1, 1, 0, draw.randrange(60)) if draw.random() < 0.9 else None
        rows.append((draw.choice("IUUDX"), seq, key, draw.choice(["ann", "", None]), at, draw.choice(["a", "b", None, f"t{k}"]), "x"))
    return rows


def by_replay(base, rows):
    """The catalog by replaying every change in order in plain Python."""
    table = {r[0]: list(r[1:]) for r in base}
    none_first = lambda x: (x is not None, x)
    rows = [r[:3] + (r[3] or "system",) + r[4:] for r in rows if r[1] is not None and r[2] is not None and r[0] in "IUD"]
    for op, _, key, actor, at, note, description in sorted(rows, key=lambda r: (r[1], r[0], *map(none_first, (r[4], r[3], r[5], r[6])))):
        if op == "D":
            table.pop(key, None)
        elif op == "I" and key not in table:
            table[key] = [note, description, actor, at, None, at]
        elif op == "U" and key in table:
            table[key] = [note, description, table[key][2], table[key][3], actor, at]
    return sorted((key, *row) for key, row in table.items())


def shown(frame):
    return sorted((tuple(r) for r in frame.select(*NOTES.fieldNames()).collect()), key=lambda r: r[0])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ties_and_missing_numbers_equal_a_replay(spark, seed):
    base = stored(spark, 12)
    rows = [r for r in random_changes(seed, 400, 12) if r[2] is not None]
    assert shown(apply_changes(base, spark.createDataFrame(rows, SCHEMA), NOTE_FIELDS)) == by_replay(base.collect(), rows)


def test_changes_without_seq_are_refused(spark):
    rows = [("I", None, "a", "x", None, "n", "d"), ("D", None, "a", "x", None, None, None), ("D", 1, "a", "x", None, None, None), ("U", None, "a", "x", None, " ", "d")]
    reasons = [r.reason for r in checked_changes(spark.createDataFrame(rows, SCHEMA), *NOTE_RULE).collect()]
    assert reasons == [NO_SEQ, NO_SEQ, None, NOTE_RULE[1]]


@pytest.mark.parametrize("order", [1, 2])
def test_batches_in_any_order_give_the_batch_result(spark, tmp_path, order):
    """Late batches bring older numbers: deletes before and after what was applied, inserts laid open again."""
    base = stored(spark, 12)
    rows = [r for r in random_changes(7, 240, 12) if r[2] is not None]
    rows += [("I", 1, "q", "u", None, "first", "x"), ("I", 90, "q", "u", None, "second", "x"), ("D", 50, "q", "u", None, None, None)]
    random.Random(order).shuffle(rows)
    source = str(tmp_path / "in")

    def take(part):
        spark.createDataFrame(part, SCHEMA).coalesce(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(source)
        writer = keyed_catalog_writer(stream, base, NOTE_FIELDS, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        writer.trigger(availableNow=True).start().awaitTermination()

    for i in range(3):
        take(rows[i::3])
        now = [r for k in range(i + 1) for r in rows[k::3]]
        assert shown(keyed_catalog(spark, base, str(tmp_path / "out"))) == by_replay(base.collect(), now)
    whole = apply_changes(base, spark.createDataFrame(rows, SCHEMA), NOTE_FIELDS)
    assert shown(keyed_catalog(spark, base, str(tmp_path / "out"))) == shown(whole)
