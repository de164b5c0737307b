"""Walks at scale: rows of a task, plans that make their inputs once, and depths told by replacements."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from keydrift.functions.tree import nesting_depth
from keydrift.operators import diff, grams, merge, validate
from keydrift.operators.diff import missing_counts, missing_keys
from keydrift.operators.members import missing_members, source_members, target_paths
from keydrift.operators.merge import import_selected
from keydrift.plans.queries import QUERIES
from keydrift.sources import tables

PAIRS = [(1, '{"a":1,"c":{"x":0}}', '{"a":2,"b":{"y":[1]},"c":{"x":1,"z":null}}'), (2, "[]", '{"0":1,"k":2}'), (None, "{}", '{"n":1}')]


def pairs(spark):
    return spark.createDataFrame(PAIRS, "pair_id bigint, target_json string, source_json string")


def test_spread_bounds_the_rows_of_a_task_where_splits_are_as_many_as_cores(spark, monkeypatch):
    monkeypatch.setattr(tables, "SPREAD_ROWS", 100)
    frame = spark.range(0, 4000, 1, 2 * spark.sparkContext.defaultParallelism)
    found = tables.spread(frame).groupBy(F.spark_partition_id()).count()
    assert tables.spread(frame).rdd.getNumPartitions() == 40
    assert found.agg(F.max("count")).first()[0] <= 150


def test_spread_leaves_scans_of_enough_splits(spark, monkeypatch):
    monkeypatch.setattr(tables, "SPREAD_ROWS", 100)
    frame = spark.range(0, 400, 1, 9)
    assert tables.spread(frame) is frame


def test_target_paths_are_made_once_for_both_joins(spark, monkeypatch_conf):
    monkeypatch_conf("spark.sql.adaptive.enabled", "false")
    monkeypatch_conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    both = pairs(spark)
    found = missing_members(source_members(both, "source_json"), target_paths(both, "target_json"))
    shown = io.StringIO()
    with redirect_stdout(shown):
        found.explain()
    assert "ReusedExchange" in shown.getvalue()
    assert sorted((r.pair_id, tuple(r.path)) for r in found.collect()) == [(1, ("b",)), (1, ("c", "z")), (2, ("0",)), (2, ("k",))]


def test_counts_are_those_of_the_missing_keys(spark):
    rows = missing_keys(pairs(spark)).groupBy("pair_id").count().collect()
    counts = missing_counts(pairs(spark)).select("pair_id", "n_missing").collect()
    assert {tuple(r) for r in counts} == {tuple(r) for r in rows} == {(1, 2), (2, 2), (None, 1)}


def test_counting_carries_no_paths(spark):
    shown = io.StringIO()
    with redirect_stdout(shown):
        missing_counts(pairs(spark)).explain()
    assert "array_sort" not in shown.getvalue() and "ordinal" not in shown.getvalue()


def test_depths_of_shallow_deep_and_unbalanced_texts(spark):
    deep = "[" * 30 + "]" * 30
    texts = {"1": 0, "{}": 1, '{"a":[{},[]],"b":{"c":"{[{["}}': 3, deep: 30, "{}}{{": 1, "[[[": 3, "}{": 0, '{"': 1, "": 0, None: 0}
    frame = spark.createDataFrame([(t, n) for t, n in texts.items()], "t string, n int")
    assert frame.where(nesting_depth(F.col("t")) != F.col("n")).collect() == []


def test_postings_are_dealt_out_by_hash_and_take_grams_once(spark, tmp_path, monkeypatch_conf):
    """A frequent gram fills several files; the texts are read twice for the rows' ranges and once for the postings."""
    monkeypatch_conf("spark.sql.adaptive.coalescePartitions.enabled", "false")
    read = spark.sparkContext.accumulator(0)

    def seen(title):
        read.add(1)
        return title

    rows = spark.range(600).selectExpr("CAST(id AS STRING) AS id", "'the ' || id AS title", "timestamp'2024-01-01 00:00:00' AS create_at")
    rows = rows.unionByName(rows.limit(1).withColumn("id", F.lit(None).cast("string")))
    index = grams.write_index(rows.withColumn("title", F.udf(seen)("title")), ("title",), str(tmp_path / "index"), folders=2)
    assert read.value <= 3 * 601
    held = index.postings(spark).where("gram = 'the'").withColumn("file", F.input_file_name())
    assert held.count() == 601 and held.select("file").distinct().count() > 1
    found = grams.search_index(spark, index, "the 59")
    assert sorted(r.id for r in found.collect()) == sorted(["59", *(str(n) for n in range(590, 600))])


def test_history_is_ordered_in_tasks_of_bounded_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "SPREAD_ROWS", 50)
    made = spark.range(999, -1, -1).selectExpr("id AS o_orderkey", "id AS o_custkey", "'O' AS o_orderstatus", "'1-URGENT' AS o_orderpriority")
    made.write.parquet(str(tmp_path / "orders.parquet"))
    found = QUERIES["history_rows"](spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    assert [(r.pair_id, r.batch_seq) for r in found] == sorted((r.pair_id, r.batch_seq) for r in found)
    pairs_of = {}
    for r in found:
        pairs_of.setdefault(r.task, set()).add(r.pair_id)
    assert len({r.pair_id for r in found}) == 1000 and max(map(len, pairs_of.values())) <= 200


def test_pairs_without_a_choice_are_not_parsed(spark, monkeypatch):
    def parsed(text):
        return F.when(F.contains(text, F.lit("left alone")), F.raise_error(F.lit("parsed"))).otherwise(validate.valid_marks(text))

    monkeypatch.setattr(diff, "valid_marks", parsed)
    rows = [(1, '{"a":1}', '{"b":2}'), (2, '{"a":1}', '{"b":"left alone"}'), (3, "{", '{"b":"left alone"}')]
    both = spark.createDataFrame(rows, "pair_id bigint, target_json string, source_json string")
    chosen = spark.createDataFrame([(1, ["b"])], "pair_id bigint, path array<string>")
    merged = import_selected(both, chosen)
    assert {r.pair_id: r.n_imported for r in merged.select("pair_id", "n_imported").collect()} == {1: 1, 2: 0, 3: 0}
    assert {r.pair_id: r.status for r in merged.collect()} == {1: None, 2: None, 3: "Invalid JSON"}


def test_many_choices_of_a_pair_are_cut_to_its_missing_keys(spark, monkeypatch):
    choice = [(k, p) for k in (1, 2, None) for p in (["b"], ["b"], ["c", "z"], ["c"], ["no"], [], None, ["b", None], [None])]
    chosen = spark.createDataFrame(choice, "pair_id bigint, path array<string>")
    found = []
    for most in (0, 3, 1_000):
        monkeypatch.setattr(merge, "GATHERED", most)
        found.append(sorted(import_selected(pairs(spark), chosen).select("pair_id", "merged_json", "n_imported").collect(), key=str))
    assert found[0] == found[1] == found[2] and sum(r.n_imported for r in found[0]) == 2


def test_a_pair_of_few_choices_is_not_walked_for_them(spark, monkeypatch):
    def walked(frame, keep):
        return missing_keys(frame.withColumn("source_json", F.raise_error(F.lit("walked")).cast("string")), keep=keep)

    monkeypatch.setattr(merge, "missing_keys", walked)
    chosen = spark.createDataFrame([(1, ["b"])], "pair_id bigint, path array<string>")
    assert import_selected(pairs(spark), chosen).agg(F.sum("n_imported")).first()[0] == 1
