import hashlib
import random
import re
from collections import Counter, defaultdict

from llm_rows import DOCS, edge_rows, rows_of, words
from pyspark.sql import functions as F

from keydrift.llm import near_dedup
from keydrift.llm.common import components
from keydrift.llm.exact_dedup import Deduplicator, exact_duplicates
from keydrift.llm.near_dedup import near_duplicates, shingle_sets


def test_exact_duplicates_equal_grouping(edges, clashing):
    groups = defaultdict(list)
    for doc_id, text, *_ in edge_rows():
        groups[re.sub("[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    rows = exact_duplicates(edges).collect()
    assert len(rows) == len(edge_rows())
    for text, ids in groups.items():
        own = [r for r in rows if r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()]
        known = [i for i in ids if i is not None]
        assert Counter(r.doc_id for r in own) == Counter(ids)
        assert {(r.keep_id, r.group_size) for r in own} == {(min(known, default=None), len(ids))}
        assert sum(r.kept for r in own) == 1
        assert next(r for r in own if r.kept).doc_id == min(known, default=None)
    assert rows_of(exact_duplicates(clashing)) == rows_of(exact_duplicates(edges))


def test_exact_duplicates_of_nothing(nothing):
    assert exact_duplicates(nothing).collect() == []


def test_equal_digests_of_different_bytes_are_told_apart(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i % 4}") for i in range(40)] + [(40, "single")], "doc_id long, text string")
    store = Deduplicator(spark, str(tmp_path / "store"), digest=lambda text: F.substring(text, 1, 2))
    store.ingest(docs)
    store.advance()
    rows = {r.doc_id: (r.stays.doc_id, r.copies) for r in store.resolve().collect()}
    assert rows == {i: (i % 4, 10) for i in range(40)} | {40: (40, 1)}


def test_state_goes_on_with_later_arrivals(spark, tmp_path):
    store = Deduplicator(spark, str(tmp_path / "store"))
    for batch in ([(5, "x"), (6, "y")], [(7, "x"), (2, "y")], [(1, "z")]):
        store.ingest(spark.createDataFrame(batch, "doc_id long, text string"))
        store.advance()
    rows = {r.doc_id: (r.stays.doc_id, r.copies) for r in store.resolve().collect()}
    assert rows == {5: (5, 2), 7: (5, 2), 6: (2, 2), 2: (2, 2), 1: (1, 1)}


def brute_force(docs):
    """Shingle sets, all pairs by an inverted index, and the smallest id reachable."""
    sets = {}
    for doc_id, text in docs:
        found = re.findall("[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        grams = zip(*[found[k:] for k in range(5)], strict=False)
        sets[doc_id] = set(grams) if len(found) >= 5 else {tuple(found)} if found else set()
    shared, index = Counter(), defaultdict(list)
    for doc_id, grams in sets.items():
        for g in grams:
            index[g].append(doc_id)
    for ids in index.values():
        shared.update((a, b) for i, b in enumerate(ids) for a in ids[:i])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_equal_brute_force(spark):
    docs, n = [], 0
    for group in range(40):
        base = words(group, 40 + 7 * group)
        for copy in range(1 + group % 9):
            text = list(base)
            for place in range(copy):  # drifting copies: chains around the threshold
                text[(7 + 23 * place) % len(text)] = f"x{copy}y{place}"
            docs.append((n, " ".join(text).title() if copy % 2 else "\n".join(text)))
            n += 1
    # A crowd of copies that differ in one word, and texts that share a passage only.
    crowd, passage = words(99, 200), words(98, 60)
    for k in range(400):
        docs.append((n, " ".join(crowd[:k % 150] + [f"c{k}"] + crowd[k % 150 + 1:])))
        docs.append((n + 1, " ".join(words(1000 + k, 60) + passage)))
        n += 2
    expected = brute_force(docs)
    rows = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_duplicates_of_crowds_about_the_threshold(spark):
    docs = []
    for crowd, (length, changes, copies) in enumerate([(304, 6, 500), (404, 8, 500)]):
        base = words(700 + crowd, length)
        for copy in range(copies):
            draw = random.Random(10_000 * crowd + copy)
            text = list(base)
            for place in draw.sample(range(length), changes):
                text[place] = f"x{copy}y{place}"
            docs.append((len(docs), " ".join(text)))
    expected = brute_force(docs)
    assert 1 < len({c for _, c in expected.values()}) < len(docs)
    rows = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == expected


def test_dense_regions_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 40)
    test_near_duplicates_of_crowds_about_the_threshold(spark)


def test_near_duplicates_of_edges(edges, clashing, nothing):
    rows = near_duplicates(edges).collect()
    assert len(rows) == len(edge_rows())
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert {by_id[i].component_id for i in (1, 2, 3)} == {1}
    assert by_id[8].component_id == by_id[9].component_id == 8 and by_id[8].n_shingles == 1
    assert [by_id[i].n_shingles for i in (4, 5, 6)] == [0, 0, 0] and all(by_id[i].kept for i in (4, 5, 6))
    assert by_id[11].component_id == 10
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    assert rows_of(near_duplicates(clashing)) == rows_of(near_duplicates(edges))
    assert near_duplicates(nothing).collect() == []


def test_shingles_of_slices():
    import pyarrow as pa

    texts = pa.array(["zzz", None, "A b c d e f", "", "a B\tc\nd e  f ", "x"]).slice(1)
    sets = shingle_sets(texts)
    assert [len(s) for s in sets] == [0, 2, 0, 2, 1] and (sets[1] == sets[3]).all()


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + k) for k in range(1, 80)] + [(579, 900)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 100 for i in range(100, 161)} | {i: 500 for i in [*range(500, 580), 900]}


assert DOCS
