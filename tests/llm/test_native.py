import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from llm_rows import edge_rows, rows_of, words
from pyspark.sql import functions as F

from keydrift.llm import fingerprints as f
from keydrift.llm import license_scan as scan
from keydrift.llm.sharding import BITS, CELLS, overflow, ring, sharded


def scanned(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places, base, more, score = [], set(), set(), 0.0
    for phrase, label in scan.PHRASES.items():
        parts = phrase.split()
        for k in range(len(found) - len(parts) + 1):
            if found[k : k + len(parts)] == parts:
                places.append(k)
                base.add(label)
    for k in range(len(found)):  # every block, wherever it begins
        block = set(found[k : k + scan.BLOCK])
        for label, template in scan.TEMPLATES.items():
            wanted = set(template.split())
            if len(block & wanted) >= scan.CONTAINED * len(wanted):
                more.add(label)
                score = max(score, len(block & wanted) / len(wanted))
    score = 1.0 if places else score
    return (len(found), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), score)


def test_license_scan_equals_brute_force(spark, edges, clashing, nothing):
    texts = [r[1] for r in edge_rows()]
    for k, template in enumerate(scan.TEMPLATES.values()):
        parts = template.split()
        for drop in (0, 2, 4, 9):
            kept = [w for i, w in enumerate(parts) if (i * 7 + k) % len(parts) >= drop]
            texts.append(" ".join(words(k + drop, 17 + 13 * k) + kept[::-1] + words(drop, 40)).upper())
        spread = [w for i, p in enumerate(parts) for w in ([p, f"x{i}"] if i % 2 else [p])]
        texts += [" ".join([*words(k, offset), *spread, *words(k + 1, 30)]) for offset in range(k, 100, 9)]
        texts.append(" ".join(w for i, p in enumerate(parts) for w in (p, f"y{i}", f"z{i}", f"v{i}")))
    texts += ["CC-BY cc by", "Apache  License", "apache\nlicense, MIT license gnu", "worK gnu general public license", "licensed"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = {r.doc_id: tuple(r)[1:] for r in scan.licensed(docs).collect()}
    assert rows == {i: scanned(t) for i, t in enumerate(texts)}
    assert any(r[5] and not r[4] for r in rows.values())
    assert rows_of(scan.licensed(clashing)) == rows_of(scan.licensed(edges))
    assert scan.licensed(nothing).collect() == []


def test_shards_hold_equal_counts(spark, edges, clashing, nothing):
    docs = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(2000)], "doc_id long, text string").repartition(5)
    rows, grown = sharded(docs).collect(), {r.doc_id: r.shard for r in sharded(docs, 25).collect()}
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (r.doc_id % 50 + 8, zlib.crc32(b"x" * (r.doc_id % 50)), "rows", None)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # One more shard moves what it takes itself, and little else.
    assert sum(grown[r.doc_id] != r.shard for r in rows) < 0.15 * len(rows)
    for frame in (edges, clashing):
        few = sharded(frame).collect()
        assert len(few) == len(edge_rows()) and max(Counter(r.shard for r in few).values()) == 1
    assert rows_of(sharded(edges)) == rows_of(sharded(clashing))
    assert sharded(nothing).collect() == []
    same = spark.createDataFrame([(1, "x")] * 100, "doc_id long, text string")
    assert sorted(Counter(r.shard for r in sharded(same).collect()).values()) == [4] * 20 + [5] * 4


@pytest.mark.parametrize("shards", [3, 24])
def test_shards_equal_a_replay_of_the_ring(spark, shards):
    """Hash, ring and overflow key by key in plain Python; equal rows may change places."""
    texts = [(i % 400 if i % 3 else 7, f"t{i % 400 if i % 3 else 7}") for i in range(1500)] + [(None, "same")] * 300
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    nodes = sorted(
        (xxhash.xxh64_intdigest(k.to_bytes(4, "little"), xxhash.xxh64_intdigest(s.to_bytes(8, "little"), 42)) >> 1, s)
        for s in range(shards) for k in range(64)
    )
    assert nodes == ring(spark, shards) and max(p for p, _ in nodes) < 1 << BITS
    arcs = [[] for _ in nodes]
    for doc_id, text in texts:
        crc = zlib.crc32(text.encode())
        at = xxhash.xxh64_intdigest((str(doc_id) if doc_id is not None else f"text {crc}").encode(), 42)
        cell = xxhash.xxh64_intdigest(crc.to_bytes(8, "little"), xxhash.xxh64_intdigest((at >> 1).to_bytes(8, "little"), 42))
        cell -= (cell >> 63) << 64
        arc = next((i for i, (p, _) in enumerate(nodes) if p >= at >> 1), 0)
        arcs[arc].append((cell % CELLS, at >> 1, crc, doc_id))
    room = [len(texts) // shards + (s < len(texts) % shards) for s in range(shards)]
    taken, expected = [0] * shards, []
    waiting = [sorted(a, key=lambda row: row[:3]) for a in arcs]
    for hop in range(len(nodes)):
        for i in range(len(nodes)):
            shard = nodes[(i + hop) % len(nodes)][1]
            while waiting[i] and taken[shard] < room[shard]:
                expected.append((str(waiting[i].pop(0)[3]), shard, taken[shard]))
                taken[shard] += 1
    assert sorted((str(r.doc_id), r.shard, r.slot) for r in sharded(docs, shards).collect()) == sorted(expected)


def test_many_shards_all_have_arcs(spark):
    docs = spark.createDataFrame([(i, "x") for i in range(3000)], "doc_id long, text string")
    assert sorted(Counter(r.shard for r in sharded(docs, 700).collect()).values()) == [4] * 500 + [5] * 200
    assert {s for _, s in ring(spark, 700)} == set(range(700))


def test_overflow_goes_on_clockwise():
    # Arc 10 of shard 0 has too many keys: shard 1 comes next, then shard 2.
    parts = overflow([(10, 0, 7), (20, 1, 1), (30, 2, 1)], 3)
    assert parts == [(10, 0, 3, 0, 0), (20, 0, 1, 1, 0), (30, 0, 1, 2, 0), (10, 3, 5, 1, 1), (10, 5, 7, 2, 1)]


def test_fingerprints_of_paragraphs(spark):
    texts = ["a b c\nd e f\ng", "g\na b c\nd e f", "a b c", "d e f\ng", "", "\n", "x " * 300 + "\ny"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    vector = {r.id: r.lanes for r in f.lanes(rows, ["id"], "text").collect()}
    assert vector[0] == vector[1] and vector[4] == [0] * f.LANES
    assert len({tuple(vector[i]) for i in (0, 2, 3, 4, 5, 6)}) == 6
    two = spark.createDataFrame([(vector[2], vector[3], vector[0])], "a array<long>, b array<long>, c array<long>")
    both, less = two.select(f.combined(F.col("a"), F.col("b")), f.combined(F.col("c"), F.col("b"), -1)).first()
    assert both == vector[0] and less == vector[2]


def reckoned(text):
    """A text's vector by plain Python: digests of paragraphs cut into lanes, bits of hashes of three-word runs counted."""
    vector = [0] * f.LANES
    for paragraph in text.split("\n") if text else ():
        digest = hashlib.sha256(paragraph.encode()).digest()
        for i in range(8):
            vector[i] += int.from_bytes(digest[4 * i : 4 * i + 4], "big")
        words = re.split("[ \t-\r]+", paragraph)
        for i in range(len(words) if paragraph else 0):
            run = 42
            for word in words[i : i + 3]:
                run = xxhash.xxh64_intdigest(word.encode(), run)
            for k in range(64):
                vector[8 + k] += run >> k & 1
            vector[72] += 1
    return [x % (1 << 32) for x in vector]


def test_vectors_equal_plain_sums(spark):
    texts = ["", "\n", "a\n\nb", "a\nb\n", " lead and trail ", "é 😀\tx\n" * 5, "\n".join(" ".join(words(k, 30)) for k in range(20)), "x " * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.lanes for r in f.lanes(rows, ["id"], "text").collect()}
    assert [got[i] for i in range(len(texts))] == [reckoned(t) for t in texts]

    def near(a, b):
        if a == b:
            return 1.0
        x, y = ([2 * c - v[-1] for c in v[8:72]] for v in (a, b))
        norm = math.sqrt(sum(c * c for c in x) * sum(c * c for c in y))
        return min(1.0, max(0.0, sum(c * d for c, d in zip(x, y)) / norm)) if norm else 0.0

    pairs = spark.createDataFrame([(i, j, got[i], got[j]) for i in got for j in got], "i int, j int, a array<long>, b array<long>")
    for r in pairs.select("a", "b", f.likeness(F.col("a"), F.col("b")).alias("near")).collect():
        assert abs(r.near - near(r.a, r.b)) < 1e-12


def test_edited_documents(spark, edges, clashing, nothing):
    docs = [(i * 3, "\n".join(" ".join(words(100 * i + k, 12)) for k in range(8)) + "é😀"[: i % 3]) for i in range(60)]
    docs[7] = (21, None)
    docs[9] = (27, docs[8][1])
    rows = {r.doc_id: r for r in f.fingerprinted(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    for k, (i, text) in enumerate(docs):
        text, after = text or "", docs[(k + 1) % len(docs)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (rows[i].n_chars, rows[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
    assert rows[24].fingerprint == rows[27].fingerprint and rows[24].near_next == 1.0
    usual = [r for r in rows.values() if r.doc_id not in (18, 21, 24)]
    assert sum(r.near_edited for r in usual) / len(usual) > 0.4 and sum(r.near_next for r in usual) / len(usual) < 0.15
    few = f.fingerprinted(edges).collect()
    assert len(few) == len(edge_rows()) and all(0 <= x <= 1 for r in few for x in (r.near_edited, r.near_next))
    assert len({r.fingerprint for r in few if r.doc_id in (1, 3)}) == 1
    assert rows_of(f.fingerprinted(clashing)) == rows_of(f.fingerprinted(edges))
    assert f.fingerprinted(nothing).collect() == []
    alone = f.fingerprinted(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
