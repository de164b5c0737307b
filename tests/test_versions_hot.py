import json
import random

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from keydrift.operators.diff import missing_keys
from keydrift.operators.members import missing_members, missing_shared, source_members, target_paths
from keydrift.operators.versions import digest_trees, missing_by_digests, opened_counts
from keydrift.plans import workload
from keydrift.streaming import heavy

DATA = "/root/testdata/sf0.001"
PAIRS = "pair_id long, target_json string, source_json string"
KEYS = ["a", "b", "10", "2", "é", 'q"', ""]


def values(depth):
    leaf = st.one_of(st.none(), st.booleans(), st.integers(-3, 3), st.floats(-2, 2), st.text("ab\"\\ \n", max_size=3))
    return leaf if not depth else st.one_of(leaf, st.dictionaries(st.sampled_from(KEYS), values(depth - 1), max_size=4), st.lists(values(depth - 1), max_size=3))


def shown(frame, *more):
    return sorted((*(r[c] for c in ("pair_id", *more)), tuple(r.ordinal), tuple(r.path), r.value_json) for r in frame.collect())


def turned(value, draw):
    """The same value with its keys in another order."""
    if isinstance(value, dict):
        keys = list(value)
        draw.shuffle(keys)
        return {k: turned(value[k], draw) for k in keys}
    return [turned(v, draw) for v in value] if isinstance(value, list) else value


def stored(pairs):
    return pairs.select("pair_id", "source_json").join(digest_trees(pairs, "target_json", ("pair_id",)), "pair_id")


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(values(3), values(3), st.randoms(use_true_random=False)), min_size=30, max_size=60))
def test_digests_find_the_rows_of_the_plain_comparison(spark, drawn):
    rows = []
    for i, (target, source, draw) in enumerate(drawn):
        if i % 3 == 0 and isinstance(source, dict):  # versions that share branches
            target = turned(source | {"a": target}, draw)
        rows.append((i, json.dumps(target), json.dumps(source, indent=i % 2 or None)))
    pairs = spark.createDataFrame(rows, PAIRS)
    assert shown(missing_by_digests(stored(pairs)), "seq") == shown(missing_keys(pairs), "seq")


def test_only_changed_branches_are_opened(spark):
    branch = {"x": {"y": {"z": 1}}, "w": [1, {"v": 2}]}
    base = {"one": branch, "two": branch, "three": {"k": 0}}
    texts = {
        1: base, 2: {k: turned(v, random.Random(1)) for k, v in reversed(base.items())},
        3: base | {"two": {"x": {"y": {"z": 1, "new": 5}}, "w": 3}}, 4: base | {"four": branch},
    }
    pairs = spark.createDataFrame([(i, json.dumps(base), json.dumps(t, indent=3)) for i, t in texts.items()], PAIRS)
    assert {r.pair_id: r.n_opened for r in opened_counts(stored(pairs)).collect()} == {1: 0, 2: 0, 3: 4, 4: 1}
    assert shown(missing_by_digests(stored(pairs))) == shown(missing_keys(pairs))


def test_odd_documents(spark):
    texts = ["{bad", "  ", "null", "5", '"x"', "[]", "[1,{\"k\":2}]", "{}", '{"a":1} x', '{"a":{"0":{"k":1,"j":2}}}', '{"a":[{"k":1}]}', '{"a":1,"a":{"b":2}}', None]
    rows = [(len(texts) * i + j, t, s) for i, t in enumerate(texts) for j, s in enumerate(texts)]
    pairs = spark.createDataFrame(rows, PAIRS)
    assert shown(missing_by_digests(stored(pairs))) == shown(missing_keys(pairs))


def shared(spark, sources, baselines):
    keys = ("pair_id", "baseline_id")
    asked = source_members(sources, "source_json", keys)
    return missing_shared(asked, target_paths(baselines, "target_json", ("baseline_id",)))


def test_shared_baselines_by_one_aggregation(spark):
    sources = [(i, f"b{i % 3 if i % 10 else 1}", json.dumps({"a": {"b": i, f"k{i % 4}": {"z": 1}}, "c": {"d": 1}})) for i in range(400)]
    sources = spark.createDataFrame(sources, "pair_id long, baseline_id string, source_json string")
    baselines = spark.createDataFrame([("b0", '{"a":{"b":1}}'), ("b1", '{"a":{"k1":{}},"c":3}'), ("b2", "{}")], "baseline_id string, target_json string")
    pairs = sources.join(baselines, "baseline_id")
    by_pair = missing_members(source_members(pairs, "source_json"), target_paths(pairs, "target_json"))
    assert shown(shared(spark, sources, baselines)) == shown(by_pair) == shown(missing_keys(pairs))


def test_hot_keys_are_found_and_counted(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 < 9, "hot").when(F.col("id") % 50 == 9, "warm").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key"))
    parts = [heavy.key_sketch(rows.where(F.col("key") != "none").where(F.xxhash64("key", F.lit(1)) % 2 == p), "key") for p in (0, 1, -1)]
    hot = heavy.hot_keys(parts[0].union(parts[1]).union(parts[2]), "key", rows.schema["key"].dataType)
    assert {r.key: r.salts for r in hot.collect()} == {"hot": 58, "warm": 2}
    none = heavy.hot_keys(heavy.key_sketch(rows.where("false"), "key"), "key", rows.schema["key"].dataType)
    assert none.collect() == []


def test_one_hot_baseline_is_spread_over_tasks(spark, tmp_path, monkeypatch_conf):
    """Nine of ten arriving documents refer to one baseline that nobody named."""
    monkeypatch_conf("spark.sql.adaptive.enabled", "false")
    monkeypatch_conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch_conf("spark.sql.shuffle.partitions", "16")
    sources = workload.baseline_sources(spark, DATA).withColumn("baseline_id", F.when(F.col("pair_id") % 10 < 9, "BUILDING").otherwise(F.col("baseline_id")))
    sources = sources.withColumn("baseline_id", F.when(F.col("pair_id") % 31 != 5, F.col("baseline_id")))
    baselines = workload.baselines(spark, DATA)
    arriving, out = str(tmp_path / "in"), str(tmp_path / "out")
    sources.repartition(4).write.parquet(arriving)
    stream = spark.readStream.schema(sources.schema).option("maxFilesPerTrigger", 2).parquet(arriving)
    heavy.missing_writer(stream, baselines, out, str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    expected = missing_keys(sources.join(baselines, "baseline_id"))
    assert shown(spark.read.parquet(out)) == shown(expected)
    written = [len(list((tmp_path / "out" / f"batch_id={b}").glob("part-*"))) for b in (0, 1)]
    assert min(written) >= 10  # tasks with rows of their own: the hot baseline alone has one key without salts
    found = heavy.missing_against_hot_baselines(sources, baselines)
    per_task = found.groupBy(F.spark_partition_id()).count().collect()
    assert shown(found) == shown(expected)
    assert max(r["count"] for r in per_task) < 0.3 * sum(r["count"] for r in per_task)
