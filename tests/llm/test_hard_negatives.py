import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import keydrift.llm.hard_negatives as hard
from keydrift.llm.hard_negatives import Pack, _pack, hard_negatives, products, spanning_tree, walk
from keydrift.llm.queries import op13_spanning_bounds

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows, scale=True):
    """The contract's rows by scoring every pair in whole numbers."""
    usable = []
    for vec_id, vector, label in rows:
        if None in (vec_id, vector, label) or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if scale and vec_id % 7 == 0 else label
        usable.append((vec_id, label, [math.floor(256 * float(np.float32(x))) if scale else int(x) for x in vector]))
    out = []
    anchors = {}
    for r in usable:
        if r[0] % 100 == 0:
            anchors[r[0]] = min(anchors.get(r[0], r), r)
    for anchor, label, vector in anchors.values():
        scored = [(sum(a * b for a, b in zip(vector, v)), i, other) for i, other, v in usable]
        for ps, p, _ in sorted((s for s in scored if s[2] == label and s[1] != anchor), key=lambda s: (-s[0], s[1]))[:5]:
            window = [s for s in scored if s[2] != label and 80 * ps <= 100 * s[0] <= 100 * ps]
            for rank, (ns, n, _) in enumerate(sorted(window, key=lambda s: (-s[0], s[1]))[:5], 1):
                out.append((anchor, p, rank, n, ps, ns))
    return sorted(out)


def vectors(seed, n, dim=8, labels=10, grid=None):
    draw = np.random.default_rng(seed)
    centers = draw.normal(size=(12, dim))
    points = centers[draw.integers(0, 12, n)] + 0.2 * draw.normal(size=(n, dim))
    points = np.round(points * grid) / grid if grid else points
    return [(i, [float(np.float32(x)) for x in v], int(draw.integers(0, labels))) for i, v in enumerate(points)]


def found(spark, rows, tmp_path, name):
    frame = spark.createDataFrame(rows, ROWS).withColumn("group", F.lit("x")).withColumn("score", F.lit(3)).withColumn("vector", F.lit(None).cast("string"))
    frame.repartition(3).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
    return sorted(tuple(r) for r in op13_spanning_bounds(spark, f"{tmp_path}/{name}").collect())


def test_query_on_the_given_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted(tuple(r) for r in op13_spanning_bounds(spark, folder).collect())
    assert got == brute(rows) and got


@pytest.mark.parametrize("grid", [None, 2])
def test_small_packs_and_ties(spark, tmp_path, monkeypatch, grid):
    for name, size in (("CHUNK", 50), ("BLOCK", 4), ("HELD", 2)):
        monkeypatch.setattr(hard, name, size)
    rows = vectors(4, 1700, grid=grid)
    rows += [(i + 1700, rows[5][1], 3) for i in range(300)]  # one vector many times
    assert found(spark, rows, tmp_path, "rows") == brute(rows)


def test_odd_rows(spark, tmp_path):
    rows = vectors(2, 301, dim=3, labels=3)
    rows[100] = (100, None, 1)
    rows[3] = (3, [1.0, None, 2.0], 1)
    rows[4] = (4, [float("nan"), 1.0, 1.0], 1)
    rows[5] = (5, [float("inf"), 1.0, 1.0], 1)
    rows[6] = (6, [1.0, 1.0, 1.0], None)
    rows += [(None, [1.0, 1.0, 1.0], 1), rows[200], rows[200], rows[8], rows[8], (9, [], 2), (11, [2.0], 2), (12, [0.5] * 5, 1)]
    assert found(spark, rows, tmp_path, "odd") == brute(rows)
    assert found(spark, [], tmp_path, "none") == []
    assert found(spark, [(100, [1.0], 1)], tmp_path, "one") == []


def test_no_table_goes_through_the_driver(spark, tmp_path, monkeypatch, monkeypatch_conf):
    """Blocks are repeated for every group: neither they nor their windows are broadcast, and files hold few packs."""
    monkeypatch_conf("spark.sql.autoBroadcastJoinThreshold", "10m")
    for name, size in (("CHUNK", 20), ("BLOCK", 4), ("FILE", 3)):
        monkeypatch.setattr(hard, name, size)
    plans, tables, saved = {}, {}, hard.saved

    def noted(frame, name, *more):
        frame.collect()  # afterwards the plan is the one that was run
        plans[name] = frame._jdf.queryExecution().executedPlan().toString()
        tables[name] = saved(frame, name, *more)
        return tables[name]

    monkeypatch.setattr(hard, "saved", noted)
    rows = vectors(6, 1500)
    assert found(spark, rows, tmp_path, "rows") == brute(rows)
    for name in ("positives", "negatives"):
        assert "isFinalPlan=true" in plans[name] and "SortMergeJoin" in plans[name] and "Broadcast" not in plans[name]
    a_file = [r["count"] for r in tables["chunks"].groupBy(F.input_file_name()).count().collect()]
    assert max(a_file) <= 3 and sum(a_file) == tables["chunks"].count() > 70


def test_large_numbers_are_exact():
    draw = random.Random(1)
    rows = np.array([[float(draw.randrange(-(1 << 40), 1 << 40)) for _ in range(4)] for _ in range(50)])
    want = [max(-(1 << 63), min((1 << 63) - 1, sum(int(a) * int(b) for a, b in zip(rows[0], r)))) for r in rows]
    assert products(rows, rows[0]).tolist() == want


def test_bounds_leave_out_only_what_cannot_win():
    rows = vectors(7, 400, dim=6)
    packed = Pack(_pack([(i, label, np.floor(256 * np.array(v))) for i, v, label in rows], 0))
    block = Pack(_pack([(i, label, np.floor(256 * np.array(v))) for i, v, label in rows[:60]], 0))
    edges = spanning_tree(block.vectors)
    assert sorted(a for a, _, _ in edges) == list(range(60)) and sum(p < 0 for _, p, _ in edges) == 1
    exact, kept = block.vectors @ packed.vectors.T, []

    def wanted(anchor, low, high):
        assert (low <= exact[anchor]).all() and (exact[anchor] <= high).all()
        return high >= np.sort(exact[anchor])[-5]

    scored = walk(block, edges, packed, wanted, lambda anchor, places, scores: kept.append((anchor, places, scores)))
    for anchor, places, scores in kept:
        assert (scores == exact[anchor][places]).all()
        assert set(np.argsort(exact[anchor])[-5:]) <= set(places)
    assert scored < 0.5 * exact.size  # clustered vectors: most candidates are never scored


def test_scores_are_counted(spark):
    rows = spark.createDataFrame(vectors(1, 500), ROWS).withColumn("embedding", F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double")))
    result, figures = hard_negatives(rows, F.col("vec_id") % 100 == 0)
    assert result.count() > 0
    assert {r.step: 0 < r.scored <= 5 * 500 for r in figures.collect()} == {"positives": True, "negatives": True}
