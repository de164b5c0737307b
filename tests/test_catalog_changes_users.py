import random

import pytest

from keydrift.operators import catalog, changes, users
from keydrift.plans.lookup import look_up

SAVED = "id string, title string, query string, hos_use string, create_at timestamp"


@pytest.fixture(scope="module")
def saved(spark):
    from datetime import datetime

    rows = [
        ("1", "100% Match", "select 1", "HOS-1", datetime(2024, 1, 1)),
        ("2", "snake_case", "SELECT Two", "HOS-10", datetime(2024, 1, 3)),
        ("3", "other", "x", "", None),
        ("4", "other", "y", None, datetime(2024, 1, 2)),
        ("5", "other", "z", "  ", datetime(2024, 1, 2)),
    ]
    return spark.createDataFrame(rows, SAVED)


def ids(frame):
    return [r.id for r in frame.collect()]


def test_listing_and_search(saved):
    assert ids(catalog.newest_first(saved)) == ["3", "2", "4", "5", "1"]
    assert ids(catalog.search_queries(saved, "%")) == ["1"]
    assert ids(catalog.search_queries(saved, "_")) == ["2"]
    assert ids(catalog.search_queries(saved, "SELECT", "hos-1")) == ["2", "1"]
    assert len(ids(catalog.search_queries(saved))) == 5
    # The search sees only the listed rows.
    assert ids(catalog.search_queries(saved, "select", cap=2)) == ["2"]
    assert [r.hos_use for r in catalog.facet_values(saved).collect()] == ["  ", "HOS-1", "HOS-10"]
    counts = {r.catalog: r.n_rows for r in catalog.row_counts(a=saved, b=saved.limit(2)).collect()}
    assert counts == {"a": 5, "b": 2}


FEED = "op string, seq long, id string, actor string, at timestamp, note string, description string"
NOTE = (
    "id string, note string, description string, create_by string, create_at timestamp, "
    "update_by string, update_at timestamp"
)


def replay(snapshot, feed):
    """Brute force: one change after the other."""
    rows = {r[0]: r for r in snapshot}
    for op, _, id_, actor, at, note, text in sorted(feed, key=lambda c: c[1]):
        actor = actor or "system"
        if op == "I" and id_ not in rows:
            rows[id_] = (id_, note, text, actor, at, None, at)
        elif op == "U" and id_ in rows:
            old = rows[id_]
            rows[id_] = (id_, note, text, old[3], old[4], actor, at)
        elif op == "D":
            rows.pop(id_, None)
    return set(rows.values())


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_apply_changes_equals_replay(spark, monkeypatch_conf, threshold):
    from datetime import datetime, timedelta

    draw = random.Random(7)
    start = datetime(2024, 1, 1)
    snapshot = [(f"k{i}", f"n{i}", "t", "system", start, None, start) for i in range(20)]
    feed = []
    for seq in range(600):
        # One id holds a third of the feed.
        id_ = "k0" if draw.random() < 0.33 else f"k{draw.randrange(60)}"
        feed.append(
            (draw.choice("IUD"), seq, id_, draw.choice(["", None, "me"]),
             start + timedelta(seconds=seq), f"v{seq}", f"d{seq}")
        )
    expected = replay(snapshot, feed)
    draw.shuffle(feed)
    result = changes.apply_changes(
        spark.createDataFrame(snapshot, NOTE),
        spark.createDataFrame(feed, FEED).repartition(5),
        changes.NOTE_FIELDS,
    )
    monkeypatch_conf("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert {tuple(r) for r in result.collect()} == expected


def test_every_insert_without_id_becomes_a_row(spark):
    rows = [("I", n, None, "me", None, "same", "same") for n in range(5)]
    rows += [("U", 9, None, "me", None, "x", "x"), ("D", 10, None, "me", None, None, None), (None, 11, "a", "", None, "n", "d")]
    feed = spark.createDataFrame(rows, FEED)
    empty = spark.createDataFrame([], NOTE)
    first, again = (sorted(ids(changes.apply_changes(empty, feed, changes.NOTE_FIELDS))) for _ in range(2))
    assert len(set(first)) == 5 and None not in first and first == again


def test_admitted_rows_break_no_constraint(spark):
    schema = "id string, email string, n int"
    stored = spark.createDataFrame([("1", "a", 0)], schema)
    rows = spark.createDataFrame(
        [("2", "b", 2), ("3", "b", 1), ("1", "c", 3), ("4", "a", 4), (None, "d", 5), ("5", None, 6), ("6", "e", 7)], schema
    )
    judged = changes.admitted(stored, rows, ("n",), not_null=("id", "email"), unique=("id", "email"))
    reasons = {r.n: r.reason for r in judged.collect()}
    assert reasons == {
        1: None, 2: "unique: email", 3: "unique: id", 4: "unique: email", 5: "not null: id", 6: "not null: email", 7: None
    }
    result = stored.unionByName(judged.where("reason IS NULL").drop("reason"))
    assert changes.violations(result, ("id", "email"), ("id", "email")).isEmpty()


def test_checks_and_defaults(spark):
    feed = spark.createDataFrame(
        [("I", 1, "a", "", None, " \t", "x"), ("U", 2, "b", "", None, "n", "d"),
         ("D", 3, "c", "", None, None, None), (None, 4, "d", "", None, "", "x"), ("X", 5, "e", "", None, "n", "d")],
        FEED,
    )
    checked = {r.id: r.reason for r in changes.checked_changes(feed, *changes.NOTE_RULE).collect()}
    unknown = changes.UNKNOWN_OPERATION
    assert checked == {"a": changes.NOTE_REQUIRED, "b": None, "c": None, "d": unknown, "e": unknown}
    (row,) = changes.with_insert_defaults(
        spark.createDataFrame([("t", "q", "", "")], "title string, query string, hos_use string, actor string")
    ).collect()
    assert row.hos_use is None and row.create_by == "system" and row.update_by is None
    assert row.id and row.create_at == row.update_at
    broken = changes.violations(
        spark.createDataFrame([("1", None), ("1", "x"), ("2", "x")], "id string, email string"),
        not_null=("id", "email"), unique=("id", "email"),
    )
    assert {(r.rule, r.column_name, r.key, r.n_rows) for r in broken.collect()} == {
        ("not null", "email", None, 1), ("unique", "id", "1", 2), ("unique", "email", "x", 2),
    }


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_look_up_with_a_hot_key(spark, monkeypatch_conf, threshold):
    monkeypatch_conf("spark.sql.autoBroadcastJoinThreshold", threshold)
    rows = [("hot", i) for i in range(300)] + [(f"k{i}", i) for i in range(300)] + [(None, 1)] * 50
    large = spark.createDataFrame(rows, "key string, n int")
    lookup = spark.createDataFrame(
        [("hot", "H")] + [(f"k{i}", f"v{i}") for i in range(0, 300, 2)], "key string, v string"
    )
    found = look_up(large, lookup, "key").collect()
    assert len(found) == len(rows)
    assert sum(r.v == "H" for r in found) == 300
    assert all(
        r.v == (f"v{r.n}" if r.n % 2 == 0 else None) for r in found if r.key not in (None, "hot")
    )


def test_users(spark):
    from datetime import datetime

    stored = spark.createDataFrame(
        [("1", "a@x", "deployer", "system", None, None, None),
         ("2", "b@x", "support", "system", None, None, None),
         ("3", "c@x", "deployer", "system", None, None, None),
         ("3", "d@x", "deployer", "system", None, None, None)],
        "id string, email string, role string, create_by string, create_at timestamp, "
        "update_by string, update_at timestamp",
    )
    keys = spark.createDataFrame([("1",), ("3",), ("9",), (None,)], "id string")
    found = {r.id: (r.status, r.role) for r in users.find_profiles(keys, stored).collect()}
    assert found == {
        "1": ("ok", "deployer"), "3": ("duplicate", "support"),
        "9": ("absent", "support"), None: ("absent", "support"),
    }
    logins = spark.createDataFrame(
        [("9", "late", datetime(2024, 1, 2)), ("9", None, datetime(2024, 1, 1)),
         ("1", "z", datetime(2024, 1, 1))],
        "id string, email string, login_at timestamp",
    )
    more = spark.createDataFrame(
        [("7", None, datetime(2024, 1, 3)), ("8", "b@x", datetime(2024, 1, 3))], "id string, email string, login_at timestamp"
    )
    now, refused = users.provision(stored, logins.union(more))
    new = now.where("id NOT IN ('1', '2', '3')").collect()
    assert [(r.id, r.email, r.role, r.create_by) for r in new] == [("9", "", "support", "system")]
    assert {(r.id, r.email, r.reason) for r in refused.collect()} == {("7", "", "unique: email"), ("8", "b@x", "unique: email")}
    requests = spark.createDataFrame([(1, "1"), (2, "2"), (3, "9"), (4, "3")], "n int, actor string")
    allowed = {r.n: r.allowed for r in users.gate(requests, stored).collect()}
    assert allowed == {1: True, 2: False, 3: False, 4: False}
