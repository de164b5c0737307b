"""What is kept beside a catalog: an index, pages, counts, and a history cleared by marks."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from keydrift.operators import catalog, grams, history, pages, tallies, tombstones
from keydrift.operators.changes import NOTE_FIELDS, apply_changes
from keydrift.plans import workload
from keydrift.sources.schemas import HISTORY, NOTES, QUERIES, changes_schema

DATA = "/root/testdata/sf0.001"
TIMES = [datetime(2024, 1, 1) + timedelta(hours=h) for h in range(100)]


def odd_queries(spark):
    draw = random.Random(3)
    words = ["Select", "ΣΊΣΥΦΟΣ", "çok", "😀😀", "a😀b", "naïve", "FROM", "x", "100%", "\n", "_", "İstanbul"]
    rows = [(f"q{k}", draw.choice(["", "T", "title one"]), " ".join(draw.choices(words, k=draw.randrange(6))), draw.choice(["", None, "Hos"])) for k in range(200)]
    rows += [("long", "t", "ab" * 60_000 + "needle" + "c" * 60_000, "h"), ("q1", "repeated id", "needle", None), (None, "no id", "Needle in", "h")]
    full = [(*r, "u", draw.choice([None, draw.choice(TIMES)]), None, None) for r in rows]
    schema = type(QUERIES)([type(f)(f.name, f.dataType, True) for f in QUERIES.fields])
    return spark.createDataFrame(full, schema)


def shown(frame):
    return sorted(map(str, frame.collect()))


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rows = odd_queries(spark).persist()
    return rows, grams.write_index(rows, ("title", "query"), str(tmp_path_factory.mktemp("grams") / "index"), 16)


@pytest.mark.parametrize("term", ["", "x", "%", "😀", "😀😀", "a😀b", "sel", "SELECT f", "σίσυφος", "ΣΊΣΥΦΟΣ", "ΦΟΣ ", "i̇st", "needle", "ababab", "bcc", "no such", "title one", "\n", "Needle IN"])
def test_index_finds_what_a_scan_finds(spark, indexed, term):
    rows, index = indexed
    facet = "ho" if len(term) % 2 else ""
    scanned = catalog.search_queries(rows, term, facet)
    assert shown(grams.search_index(spark, index, term, "hos_use", facet)) == shown(scanned)


def test_a_rare_term_reads_few_shelves(spark, indexed):
    rows, index = indexed
    assert grams.rarest_grams(spark, index, "zqzq") == [] and grams.rarest_grams(spark, index, "ab") is None
    rare = grams.rarest_grams(spark, index, "needle in")
    assert 0 < len(rare) <= grams.LOOKED_UP
    assert {r.id for r in grams.candidate_ids(spark, index, rare).collect()} == {None}
    plan = grams.candidate_rows(spark, index, "needle in")._jdf.queryExecution().executedPlan().toString()
    assert any("shelf" in part[:80] for part in plan.split("PartitionFilters: ")[1:])


def test_an_empty_catalog_has_an_index_and_pages(spark, tmp_path):
    none = odd_queries(spark).where("false")
    index = grams.write_index(none, ("title", "query"), str(tmp_path / "index"))
    assert grams.search_index(spark, index, "sel").count() == grams.search_index(spark, index).count() == 0
    pages.write_listing(none, str(tmp_path / "pages"))
    assert pages.page(spark, none.schema, str(tmp_path / "pages"), 10).count() == 0


@pytest.mark.parametrize("size", [7, 60])
def test_pages_follow_each_other_without_gap(spark, tmp_path, size):
    rows = odd_queries(spark).where("title <> 'repeated id'").persist()
    expected = [r.id for r in catalog.newest_first(rows).collect()]
    path, after, got = str(tmp_path / "pages"), None, []
    pages.write_listing(rows, path, file_rows=20)
    files = spark.read.parquet(f"{path}/bounds").count()
    while True:
        taken = pages.page(spark, rows.schema, path, size, after).collect()
        if not taken:
            break
        # Ranges are found by sampling, so files differ in size.
        assert len(pages.chunks_of(spark, path, size, after)) < files
        got += [r.id for r in taken]
        after = (taken[-1].create_at, taken[-1].id)
    assert got == expected


def test_counts_follow_every_batch(spark):
    draw = random.Random(5)
    base = spark.createDataFrame([(str(i), "n", f"d{i % 3}", "s", TIMES[0], None, None) for i in range(30)], NOTES)
    now, counts, schema = base, tallies.tally(base, "description"), changes_schema(*NOTE_FIELDS)
    for batch in range(3):
        rows = []
        for k in range(60):
            key = "0" if draw.random() < 0.3 else draw.choice([str(draw.randrange(40)), None])
            rows.append((draw.choice("IUUDX"), draw.choice([None, batch * 100 + k]), key, "u", TIMES[k], "n", draw.choice(["d0", "d9", "", None])))
        feed = spark.createDataFrame(rows, schema)
        counts = tallies.updated_tally(counts, tallies.tally_changes(now, feed, NOTE_FIELDS, "description"))
        now = spark.createDataFrame(apply_changes(now, feed, NOTE_FIELDS).collect(), NOTES.fromJson({**NOTES.jsonValue(), "fields": [{**f, "nullable": True} for f in NOTES.jsonValue()["fields"]]}))
        counts = spark.createDataFrame(counts.collect(), counts.schema)
        assert shown(counts) == shown(tallies.tally(now, "description"))
    assert counts.agg(F.sum("n_rows")).first()[0] == now.count()
    assert shown(tallies.listed_values(counts)) == shown(catalog.facet_values(now, "description").withColumnRenamed("description", "facet_value"))


def test_no_changes_move_no_count(spark):
    base = workload.note_snapshot(spark, DATA)
    feed = workload.note_changes(spark, DATA).where("false")
    assert tallies.tally_changes(base, feed, NOTE_FIELDS, "description").count() == 0


def replay(steps):
    """History by doing each step to a list; rows are pair, time, place."""
    kept, last = [], {}
    for kind, rows, at in steps:
        if kind == "add":
            kept += rows
        else:
            last |= {p: max(at, last.get(p, at)) for p in rows if p is not None}
    return [(p, t, s) for p, t, s in kept if p not in last or (t is not None and t > last[p])]


@pytest.mark.parametrize("seed", [1, 2])
def test_clears_by_marks_equal_a_replay(spark, tmp_path, seed):
    draw, store, steps = random.Random(seed), tombstones.HistoryStore(str(tmp_path / "history")), []
    tombstones.begin_history(spark, store)
    assert tombstones.current_history(spark, store).count() == 0 and tombstones.compact(spark, store) == []
    for step in range(8):
        if step % 2 == 0:
            rows = [(1 if draw.random() < 0.5 else draw.randrange(6), draw.choice([None, *TIMES]), s) for s in range(40)]
            frame = spark.createDataFrame([(p, t, s, ["k"], "1", history.ALL) for p, t, s in rows], HISTORY)
            tombstones.append_rows(frame, store)
            steps.append(("add", rows, None))
        else:
            at, gone = draw.choice(TIMES), [draw.randrange(8), draw.randrange(8), None]
            tombstones.clear_pairs(spark.createDataFrame([(p,) for p in gone * 2], "pair_id bigint"), store, F.lit(at))
            steps.append(("clear", gone, at))
        if step in (3, 4, 7):
            shelves = tombstones.compact(spark, store)
            assert tombstones.compact(spark, store) == []
            assert len(shelves) <= 4
        now = sorted(((r.pair_id, r.ts, r.batch_seq) for r in tombstones.current_history(spark, store).collect()), key=str)
        assert now == sorted(replay(steps), key=str)


def test_compaction_rewrites_cleared_shelves_only(spark, tmp_path):
    path = tmp_path / "history"
    store = tombstones.HistoryStore(str(path))
    tombstones.begin_history(spark, store)
    rows = [(p, TIMES[0], s, ["k"], "1", history.ALL) for p in range(400) for s in range(2)]
    tombstones.append_rows(spark.createDataFrame(rows, HISTORY), store)
    before = {f: f.stat().st_mtime_ns for f in (path / "rows").rglob("*.parquet")}
    tombstones.clear_pairs(spark.createDataFrame([(7,)], "pair_id bigint"), store, F.lit(TIMES[1]))
    (shelf,) = tombstones.compact(spark, store)
    after = {f: f.stat().st_mtime_ns for f in (path / "rows").rglob("*.parquet")}
    others = lambda files: {f: t for f, t in files.items() if f.parent.name != f"shelf={shelf}"}
    assert others(before) == others(after) and before != after
    assert spark.read.parquet(str(path / "rows")).where("pair_id = 7").count() == 0
    assert tombstones.current_history(spark, store).count() == 798
