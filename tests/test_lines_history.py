from golden import GOLDEN
from pyspark.sql import functions as F

from keydrift.operators import history, lines
from keydrift.operators.diff import missing_keys
from keydrift.operators.merge import import_all, import_selected

PAIR = "pair_id string, target_json string, source_json string"


def test_first_and_exact_line_differ(spark):
    pairs = spark.createDataFrame(
        [
            ("far", '{"p":{"k":1}}', '{"p":{"k":1},"k":2}'),
            ("plain", '{"c":3,"a":1}', '{"a":1,"b":2,"c":3}'),
            ("escaped", "{}", '{"a\\\\b":1,"q\\"r":2,"ok":3}'),
        ],
        PAIR,
    )
    merged = import_all(pairs)
    exact = {(r.pair_id, r.path[-1]): r.line_no for r in lines.exact_lines(merged).collect()}
    assert exact == {
        ("far", "k"): 5, ("plain", "b"): 3,
        ("escaped", "a\\b"): 2, ("escaped", 'q"r'): 3, ("escaped", "ok"): 4,
    }
    marked = {r.pair_id: r.line_nos for r in lines.highlights(merged).collect()}
    assert marked == {"far": [3], "plain": [3], "escaped": [4]}


def test_first_match_equals_a_plain_search(spark):
    rows = [(name, target, source) for name, (target, source, _, _) in GOLDEN.items()]
    rows.append(("odd", "{}", '{"x":"v","x\\": \\"v":1}'))
    rows.append(("odder", "{}", '{"a\\"b":1,"a\\\\\\"b":2,"a":"b","a\\": \\"b":[1],"z\\"":0}'))
    merged = import_all(spark.createDataFrame(rows, PAIR)).persist()
    texts = {r.pair_id: r.merged_json.split("\n") for r in merged.collect()}
    found = {
        (r.pair_id, tuple(hit.path)): hit.line_no
        for r in lines.located_lines(merged).collect()
        for hit in r.located
    }
    expected = {}
    for r in lines.exact_lines(merged).collect():
        start = f'"{r.path[-1]}"'
        hits = [i for i, line in enumerate(texts[r.pair_id], 1) if line.strip().startswith(start)]
        if hits:
            expected[(r.pair_id, tuple(r.path))] = hits[0]
    assert found == expected
    assert found[("odd", ('x": "v',))] == 2


def test_history_of_a_selected_import(spark):
    pairs = spark.createDataFrame(
        [(1, '{"a":{}}', '{"b":{"k":[1]},"a":{"x":"s","y":1.50}}'), (2, "{}", '{"z":1}')],
        "pair_id long, target_json string, source_json string",
    )
    picked = spark.createDataFrame(
        [(1, ["a", "y"]), (1, ["b"]), (1, ["b", "k"]), (1, ["no"]), (1, ["b"])], "pair_id long, path array<string>"
    )
    merged = import_selected(pairs, picked)
    rows = history.import_history(merged, history.SINGLE).collect()
    assert {(r.pair_id, tuple(r.path), r.value_json) for r in rows} == {
        (1, ("b",), '{"k":[1]}'), (1, ("a", "y"), "1.5")
    }
    assert {r.pair_id: r.n_imported for r in merged.collect()} == {1: 2, 2: 0}


def test_history(spark, tmp_path):
    pairs = spark.createDataFrame(
        [(1, "{}", '{"b":1,"a":2}'), (2, "{}", '{"z":null}'), (3, "{bad", '{"z":1}')],
        "pair_id long, target_json string, source_json string",
    )
    found = missing_keys(pairs)
    first, second = (F.to_timestamp(F.lit(f"2024-01-0{d} 00:00:00")) for d in (1, 2))
    path = str(tmp_path / "history")
    history.append_history(history.history_rows(found, history.ALL, first), path)
    history.append_history(
        history.history_rows(found.where("pair_id = 2"), history.SINGLE, second), path
    )
    stored = spark.read.parquet(path)
    shown = history.newest_history_first(history.with_label(stored)).collect()
    assert [(r.pair_id, r.batch_seq, r.path, r.value_json, r.label) for r in shown] == [
        (2, 0, ["z"], "null", "Single"),
        (1, 0, ["b"], "1", "Bulk"),
        (1, 1, ["a"], "2", "Bulk"),
        (2, 0, ["z"], "null", "Bulk"),
    ]
    left = history.without_pairs(stored, spark.createDataFrame([(2,)], "pair_id long"))
    assert {r.pair_id for r in left.collect()} == {1}
