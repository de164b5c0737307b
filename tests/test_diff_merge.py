import json

import pytest
from golden import GOLDEN

from keydrift.operators.diff import missing_counts, missing_keys
from keydrift.operators.merge import import_all, import_selected
from keydrift.operators.validate import with_status


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(name, target, source) for name, (target, source, _, _) in GOLDEN.items()]
    return spark.createDataFrame(
        rows, "pair_id string, target_json string, source_json string"
    ).persist()


def pretty(compact):
    """Two-space JSON with keys in the order given."""
    return json.dumps(json.loads(compact), indent=2, ensure_ascii=False)


def test_golden_rows(pairs):
    found = {}
    for row in missing_keys(pairs).orderBy("pair_id", "ordinal").collect():
        found.setdefault(row.pair_id, []).append((">".join(row.path), row.value_json))
    assert found == {name: rows for name, (_, _, rows, _) in GOLDEN.items() if rows}


def test_sequence_follows_ordinal(pairs):
    for row in missing_keys(pairs).groupBy("pair_id").agg({"seq": "max", "*": "count"}).collect():
        assert row["max(seq)"] == row["count(1)"] - 1


def test_golden_merge(pairs):
    merged = {r.pair_id: r for r in import_all(pairs).collect()}
    assert set(merged) == set(GOLDEN)
    for name, (target, _, rows, expected) in GOLDEN.items():
        row = merged[name]
        assert row.n_imported == len(rows), name
        if expected is None:
            assert row.merged_json == target, name
        elif name != "24":
            assert row.merged_json == pretty(expected), name
        else:
            body = "".join(part.strip() for part in row.merged_json.split("\n"))
            assert body.replace('": ', '":') == expected


def test_merge_converges(pairs):
    merged = import_all(pairs).select("pair_id", "merged_json")
    again = pairs.join(merged, "pair_id").drop("target_json")
    again = again.withColumnRenamed("merged_json", "target_json")
    assert missing_keys(again).count() == 0


def test_same_document_has_no_rows(pairs):
    same = pairs.selectExpr("pair_id", "source_json AS target_json", "source_json")
    assert missing_keys(same).count() == 0


def test_counts_include_zero(pairs):
    counts = {
        r.pair_id: r.n_missing
        for r in missing_counts(pairs).collect()
    }
    assert counts == {name: len(rows) for name, (_, _, rows, _) in GOLDEN.items()}


def test_import_selected(spark, pairs):
    selection = spark.createDataFrame(
        [("12b", ["x"]), ("12b", ["x"]), ("12b", ["nope"]), ("10", ["10"]), ("9", ["z", "j"])],
        "pair_id string, path array<string>",
    )
    merged = {r.pair_id: r for r in import_selected(pairs, selection).collect()}
    assert json.loads(merged["12b"].merged_json) == {"x": 0, "a": {}}
    assert list(json.loads(merged["12b"].merged_json)) == ["x", "a"]
    assert merged["10"].merged_json == '{\n  "10": 2\n}'
    assert merged["9"].merged_json == pretty(GOLDEN["9"][3])
    assert merged["2"].merged_json == GOLDEN["2"][0]
    assert merged["12b"].n_imported == 1


def test_status(pairs):
    status = {r.pair_id: r for r in with_status(pairs).collect()}
    assert status["13"].target_error == "Invalid JSON" and not status["13"].comparable
    assert status["13a"].target_error == "Invalid JSON"
    assert status["14"].target_error is None and not status["14"].comparable
    assert status["14a"].target_error is None and not status["14a"].comparable
    assert status["16"].target_error is None and not status["16"].comparable
    assert not status["16a"].comparable
    assert status["17"].comparable and status["17"].error == "Target is not an object"
    assert status["15"].comparable and status["15"].error is None
    assert all(r.error is None for name, r in status.items() if name != "17")


def test_deep_document(spark):
    depth = 400
    source = '{"a":' * depth + '{"x":1}' + "}" * depth
    target = '{"a":' * depth + '{"y":1}' + "}" * depth
    pairs = spark.createDataFrame(
        [(1, target, source)], "pair_id long, target_json string, source_json string"
    )
    (row,) = missing_keys(pairs).collect()
    assert row.path == ["a"] * depth + ["x"] and row.value_json == "1"
    (merged,) = import_all(pairs).collect()
    value = json.loads(merged.merged_json)
    for _ in range(depth):
        value = value["a"]
    assert value == {"x": 1, "y": 1}


def test_large_document(spark):
    keys = 20_000
    source = json.dumps({f"k{i}": {"v": i} for i in range(keys)})
    target = json.dumps({f"k{i}": {"v": i} for i in range(0, keys, 2)})
    pairs = spark.createDataFrame(
        [(1, target, source)], "pair_id long, target_json string, source_json string"
    )
    assert missing_keys(pairs).count() == keys // 2
    (merged,) = import_all(pairs).collect()
    assert list(json.loads(merged.merged_json)) == [f"k{i}" for i in range(keys)]
    assert merged.n_imported == keys // 2


def test_documents_at_the_parsers_limits(spark):
    """Long keys, numbers and strings and deep nesting beside a normal pair: no job fails, no row is lost."""
    long_key, number, text = "k" * 49_998, "9" * 1200, "x" * 20_000_001
    sources = {
        "plain": '{"a":1}',
        "key": f'{{"{long_key}":1}}',
        "number": f'{{"a":{number}}}',
        "string": f'{{"a":"{text}"}}',
        "deep": '{"a":' * 900 + "1" + "}" * 900,
        "longer key": '{"%s":1}' % ("k" * 50_000),
        "deeper": '{"a":' * 1100 + "1" + "}" * 1100,
        "wrong": '{"a":1',
    }
    pairs = spark.createDataFrame([(k, "{}", v) for k, v in sources.items()], "pair_id string, target_json string, source_json string")
    beyond = {"longer key", "deeper"}
    found = {r.pair_id: (r.path, len(r.value_json)) for r in missing_keys(pairs).collect()}
    assert set(found) == set(sources) - beyond - {"wrong"}
    assert found["key"] == ([long_key], 1) and found["string"][1] == len(text) + 2
    for frame in (missing_counts(pairs), import_all(pairs)):
        status = {r.pair_id: r.status for r in frame.collect()}
        assert {k for k, v in status.items() if v == "Beyond parser limits"} == beyond
        assert {k for k, v in status.items() if v == "Invalid JSON"} == {"wrong"}
    errors = {r.pair_id: r.source_error for r in with_status(pairs).collect()}
    assert {k for k, v in errors.items() if v == "Beyond parser limits"} == beyond
