import pyarrow.parquet as pq
from llm_rows import DOCS, edge_rows, words

import __spark_entry__ as contract
import corpus_pipeline as pipeline
from keydrift.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = contract.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert "pipeline" in names and set(ORACLE) <= set(QUERIES)


def test_stages_keep_columns_and_drop_what_they_reject(spark, tmp_path):
    rows = list(edge_rows()) + [(100 + i, " ".join(words(i, 50)), "en", "z", 1) for i in range(60)]
    rows += [(200 + i, " ".join([*words(900 + i, 40), "idiot", "moron", "idiot", "moron"]), "en", "z", 1) for i in range(30)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(100 + i, 0) for i in range(60)] + [(200 + i, 1) for i in range(30)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        path = str(tmp_path / f"out{k}")
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]
        left[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    assert not {4, 5, 6, 14} & set(left["language_id"]) and {1, 2, 3, 7, 8, 12} <= set(left["language_id"])
    assert not any(i is not None and 200 <= i < 230 for i in left["toxicity"]) and set(range(100, 160)) <= set(left["toxicity"])
    assert left["exact_dedup"].count(1) == 1 and 3 not in left["exact_dedup"] and 2 in left["exact_dedup"]
    assert 2 not in left["near_dedup"] and 1 in left["near_dedup"]
    assert set(left["packing"]) == set(left["near_dedup"])


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    columns = ["doc_id", "start", "length", "doc_tokens"]
    ran = pipeline.run(spark, DATA)
    total = lambda frame: frame.selectExpr("count(DISTINCT doc_id)", "sum(length)").first()
    assert total(ran.select(*columns)) == total(docs.select(*columns))
    assert pq.read_table(f"{DATA}/documents.parquet").num_rows >= total(ran)[0] > 0


def stage_rows(spark, name, rows, folder, labels=()):
    spark.createDataFrame(list(labels), "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.createDataFrame(rows, DOCS)
    return sorted((str(r.doc_id), r.text) for r in dict(pipeline.STAGES)[name](spark, docs, str(folder)).collect())


def test_texts_of_one_id_or_none_are_judged_one_by_one(spark, tmp_path):
    good = [(i, " ".join(words(i, 60)), "en", "z", 1) for i in range(150)]
    mean = [(1000 + i, " ".join([*words(700 + i, 40), "idiot", "moron", "idiot", "moron"]), "en", "z", 1) for i in range(60)]
    odd = [(3, "12 34", None, None, 1), (3, None, None, None, None), (None, "--", None, None, 1), (None, good[7][1] + " so", "en", "z", 1)]
    said = stage_rows(spark, "language_id", good + odd, tmp_path / "a")
    assert said == sorted((str(r[0]), r[1]) for r in [*good, odd[3]])
    labels = [(r[0], 0) for r in good] + [(r[0], 1) for r in mean]
    odd = [(3, mean[5][1] + " x", "en", "z", 1), (None, mean[6][1] + " y", "en", "z", 1), (None, good[9][1] + " so", "en", "z", 1)]
    said = stage_rows(spark, "toxicity", good + mean + odd, tmp_path / "b", labels)
    assert said == sorted((str(r[0]), r[1]) for r in [*good, odd[2]])
    near = good[4][1].replace(good[4][1].split()[30], "changed")
    odd = [(4, near, "en", "z", 1), (None, good[8][1] + " end", "en", "z", 1), (5, " ".join(words(990, 60)), "en", "z", 1)]
    texts = {t for _, t in stage_rows(spark, "near_dedup", good + odd, tmp_path / "c")}
    assert len(texts) == 151 and odd[2][1] in texts and (good[4][1] in texts) != (near in texts)


def test_empty_table(spark, tmp_path, nothing):
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    nothing.write.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_worker_gives_back_memory_around_making_what_it_keeps(monkeypatch):
    from keydrift.llm import common

    done = []
    monkeypatch.setattr(common, "given_back", lambda: done.append("given back"))
    for name in ("first", "first", "second"):
        assert common.kept_by_worker(f"test {name}", lambda: done.append("made") or name) == name
    assert done == ["given back", "made", "given back"] * 2
