import pytest

from keydrift.operators.changes import NOTE_FIELDS, apply_changes
from keydrift.operators.diff import missing_keys
from keydrift.operators.history import ALL, history_rows
from keydrift.operators.members import missing_members, source_members, target_paths
from keydrift.operators.merge import import_all
from keydrift.plans import workload
from keydrift.plans.session import configure, require_settings
from keydrift.sources.schemas import NOTES, PAIRS, QUERIES, changes_schema
from keydrift.sources.tables import document_pairs, scan_notes, scan_queries, scan_users, write_documents, write_snapshot
from keydrift.streaming import streams

DATA = "/root/testdata/sf0.001"


def shown(frame):
    return sorted((r.pair_id, tuple(r.path), r.value_json) for r in frame.collect())


@pytest.fixture(scope="module")
def pairs(spark):
    return workload.config_pairs(spark, DATA).persist()


def test_join_form_equals_pairwise_form(pairs):
    joined = missing_members(source_members(pairs, "source_json"), target_paths(pairs, "target_json"))
    assert shown(joined) == shown(missing_keys(pairs))


@pytest.mark.parametrize("files", [1, 4])
def test_stream_equals_batch(spark, pairs, tmp_path, files):
    arriving, out = str(tmp_path / "in"), str(tmp_path / "out")
    pairs.repartition(files).write.parquet(arriving)
    stream = spark.readStream.schema(PAIRS).option("maxFilesPerTrigger", 1).parquet(arriving)
    rows = history_rows(missing_keys(stream), ALL)
    query = (
        streams.history_writer(rows, out, str(tmp_path / "check")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert shown(spark.read.parquet(out)) == shown(missing_keys(pairs))


@pytest.mark.parametrize("hot", [(), ("BUILDING", "MACHINERY")])
def test_stream_against_baselines(spark, tmp_path, hot):
    sources = workload.baseline_sources(spark, DATA)
    baselines = workload.baselines(spark, DATA)
    expected = shown(streams.missing_against_baselines(sources, baselines))
    arriving, out = str(tmp_path / "in"), str(tmp_path / "out")
    sources.repartition(3).write.parquet(arriving)
    stream = spark.readStream.schema(sources.schema).parquet(arriving)
    found = streams.missing_against_baselines(stream, baselines, hot=hot)
    writer = found.writeStream.format("parquet").option("path", out)
    query = writer.option("checkpointLocation", str(tmp_path / "check"))
    query.trigger(availableNow=True).start().awaitTermination()
    assert shown(spark.read.parquet(out)) == expected


def test_change_feed(spark, tmp_path):
    schema = changes_schema(*NOTE_FIELDS)
    feed = workload.note_changes(spark, DATA).select(*schema.fieldNames())
    log = str(tmp_path / "log")

    def take(rows, name, feed_name, checkpoint):
        rows.repartition(2).write.mode("append").parquet(str(tmp_path / name))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
        writer = streams.change_log_writer(stream, log, feed_name, str(tmp_path / checkpoint))
        writer.trigger(availableNow=True).start().awaitTermination()

    def same(now, upto):
        expected = apply_changes(base, feed.where(upto), NOTE_FIELDS)
        assert set(now.columns) == set(NOTES.fieldNames())
        assert sorted(map(str, now.collect())) == sorted(map(str, expected.collect()))

    base = workload.note_snapshot(spark, DATA).persist()
    take(feed.where("seq < 500"), "in1", "one", "check1")
    # A second feed with a checkpoint of its own replaces nothing of the first.
    take(feed.where("seq >= 500 AND seq < 900"), "in2", "two", "check2")
    same(streams.current_catalog(spark, base, log, schema, NOTE_FIELDS), "seq < 900")
    with pytest.raises(ValueError, match="begun with checkpoint"):
        take(feed.where("seq < 10"), "in3", "one", "check3")
    rolled, taken = streams.roll_forward(spark, base, log, schema, NOTE_FIELDS, str(tmp_path / "snapshot"))
    same(rolled, "seq < 900")
    take(feed.where("seq >= 900"), "in1", "one", "check1")
    same(streams.current_catalog(spark, rolled, log, schema, NOTE_FIELDS, taken), "true")
    same(streams.current_catalog(spark, base, log, schema, NOTE_FIELDS), "true")


def test_documents_from_folders(spark, tmp_path):
    for side, files in {
        "main": {"a.json": '{\n "x": 1\n}\n', "only.json": "{}"},
        "dev": {"a.json": '{"x":1,"y":[2]}'},
    }.items():
        (tmp_path / side).mkdir()
        for name, text in files.items():
            (tmp_path / side / name).write_text(text)
    pairs = document_pairs(spark, str(tmp_path / "main"), str(tmp_path / "dev"))
    assert shown(missing_keys(pairs)) == [("a", ("y",), "[2]")]
    write_documents(import_all(pairs), str(tmp_path / "text"), as_text=True)
    text = {r.pair_id: r.merged_json for r in spark.read.json(str(tmp_path / "text")).collect()}
    assert text == {"a": '{\n  "x": 1,\n  "y": [\n    2\n  ]\n}', "only": "{}"}
    (tmp_path / "main" / "a.txt").write_text("{}")
    names = {r.pair_id for r in document_pairs(spark, str(tmp_path / "main"), str(tmp_path / "dev")).collect()}
    assert names == {"a.json", "a.txt", "only"}


def test_tables_and_snapshots(spark, tmp_path):
    notes = workload.note_snapshot(spark, DATA)
    write_snapshot(notes, str(tmp_path / "notes"))
    assert scan_notes(spark, str(tmp_path / "notes")).count() == notes.count()
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_snapshot(notes, str(tmp_path / "notes"))
    queries = workload.saved_queries(spark, DATA)
    write_snapshot(queries, str(tmp_path / "queries"))
    stored = scan_queries(spark, str(tmp_path / "queries"))
    assert stored.count() == queries.count() and stored.columns == QUERIES.fieldNames()
    users = workload.profiles(spark, DATA)
    write_snapshot(users, str(tmp_path / "users"))
    assert scan_users(spark, str(tmp_path / "users")).where("role = 'deployer'").count() > 0


def test_settings_are_required(spark):
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "EXCEPTION")
    with pytest.raises(ValueError, match="mapKeyDedupPolicy"):
        require_settings(spark)
    configure(spark)
    require_settings(spark)
