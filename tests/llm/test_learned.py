import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import edge_rows, rows_of, words

from keydrift.llm import language_id, toxicity

SYLLABLES = {"en": ("the", "ing", "wh", "ou", "th"), "fr": ("eau", "que", "é", "oi", "ai"), "de": ("sch", "ung", "ß", "ei", "ch")}


@pytest.fixture(scope="module")
def spoken(spark):
    rows = [(i, " ".join(words(i, 5 + i % 60, SYLLABLES[lang])), lang) for i, lang in zip(range(900), itertools.cycle(SYLLABLES))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").persist()


def test_language_of_held_out_documents(spoken):
    lang = {r.doc_id: r.lang for r in spoken.collect()}
    rows = [r for r in language_id.languages(spoken).collect() if r.held_out]
    assert len(rows) > 150 and np.mean([r.lang_pred == lang[r.doc_id] for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_fast_tables_equal_the_network(spoken):
    net = language_id.learn(spoken, rows=200)
    batch, _, _ = language_id.windows(pa.array([r.text for r in spoken.limit(20).collect()]))
    x = np.maximum(language_id._convolved(net, batch).max(axis=1), 0)
    slow = language_id._softmax(x @ net.dense + net.offset)
    assert np.allclose(language_id.Fast(net).probabilities(batch), slow, atol=1e-4)


def test_windows_hold_the_whole_text():
    texts = ["", None, "x" * 1000, "é" * 300, "ab"]
    rows, row, held = language_id.windows(pa.array(texts))
    for i, text in enumerate(texts):
        data = b"".join(rows[k][: held[k]].tobytes() for k in np.flatnonzero(row == i))
        assert data == (text or "").encode()


def test_language_of_edges(spoken, edges, clashing, nothing):
    net = language_id.learn(spoken, rows=200)
    rows = language_id.identified(edges, net).collect()
    assert len(rows) == len(edge_rows())
    unknown = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert {4, 5, 6, 14} <= unknown and not unknown & {1, 7, 8, 12}
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert rows_of(language_id.languages(clashing)) == rows_of(language_id.languages(edges))
    assert language_id.languages(nothing).collect() == []
    assert {r.lang_pred for r in language_id.identified(edges, None).collect()} == {"und"}


def edits(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        line, before = [i], line
        for j, y in enumerate(b, 1):
            line.append(min(line[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return line


def test_automaton_equals_edit_distances():
    entries = {"idiot": True, "worthless": True, "disgusting": True, "scum": True, "lowei*": True, "réeuxa*": True, "achl*": False}
    found = toxicity.Automaton(entries)
    draw = random.Random(5)
    tried = []
    for entry in entries:
        for _ in range(300):
            word = list(entry.rstrip("*") + (draw.choice(["", "ab", "schaft"]) if entry.endswith("*") else ""))
            for _ in range(draw.randrange(4)):
                at = draw.randrange(len(word) + 1)
                word[at : at + draw.randrange(2)] = draw.choice(["", "x", "é", "i", "o", "1"])
            tried.append("".join(word))
    tried = [w for w in tried if w]
    hits, count = toxicity.matches(" ".join(tried), found)
    got = dict(hits)
    place = 0
    for word in tried:
        grade = 9
        for entry, strong in entries.items():
            stem = entry.rstrip("*")
            if entry.endswith("*"):
                n = min(edits(stem, word[:k])[-1] for k in range(len(word) + 1))
            else:
                n = edits(stem, word)[-1]
            if n <= toxicity.reach(entry, strong):
                grade = min(grade, 1 + n if n else int(not strong))
        assert got.get(place, 9) == grade, word
        place += len(word) + 1
    assert count == len(tried)


def test_words_of_any_script_and_beside_signs():
    found = toxicity.Automaton({"나쁜놈": True, "scum": True, "worthless": True, "ばか": True, "笨蛋": True})
    for text, start in (("나쁜놈", 0), ("이 나쁜놈!", 2), ("scum😀", 0), ("scum。", 0), ("😀😀worthless😀😀", 2), ("ばか、", 0), ("(笨蛋)", 1), ("x\U0001f600Worthles", 2)):
        assert [at for at, _ in toxicity.matches(text, found)[0]] == [start], text
    assert toxicity.matches("나쁜 놈 scumx", found)[0] == []


def test_many_letters_and_many_long_entries(monkeypatch):
    draw = random.Random(2)
    wide = {"".join(chr(0xAC00 + draw.randrange(3000)) for _ in range(4)): True for _ in range(300)}
    found = toxicity.Automaton(wide)
    assert len(found.letters) > 300 and found.grade_all(list(wide)) == [0] * len(wide)
    long = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(11)) for _ in range(2000)]
    found = toxicity.Automaton(dict.fromkeys(long, True))
    tried = [w[:4] + w[5:] for w in long[:40]] + [w[:2] + "é" + w[2:9] + w[10:] for w in long[:20]] + [w[::-1] for w in long[:20]]
    want = [min([1 + n if n else 0 for n in (edits(e, w)[-1] for e in long) if n <= 2], default=9) for w in tried]
    assert found.grade_all(tried) == want
    monkeypatch.setattr(toxicity, "STEPS", 50)  # forgotten steps are made again
    assert toxicity.Automaton(dict.fromkeys(long, True)).grade_all(tried) == want


def test_quotation_is_told_by_its_context():
    assert toxicity.quoted('he was called "an idiot" by them', 18)
    assert toxicity.quoted("she said: idiot", 10)
    assert not toxicity.quoted("you idiot go away", 4)


@pytest.fixture(scope="module")
def judged(spark):
    docs, labels = [], []
    for i in range(600):
        text, toxic = words(i, 80), int(i % 5 == 0)
        if toxic:
            for k in range(2 + i % 4):
                text[11 * k] = ["Idiot", "moron", "scum"][(i + k) % 3]
        docs.append((i, " ".join(text)))
        labels.append((i, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string").persist(), spark.createDataFrame(labels, "doc_id long, toxic int").persist()


def test_toxicity_of_held_out_documents(judged):
    docs, labels = judged
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.toxic_documents(docs, labels).collect()
    assert len(rows) == 600 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == toxic[r.doc_id] for r in rows if r.held_out)
    model = toxicity.learn(docs, labels)
    assert {"idiot", "moron", "scum"} <= set(model.entries)
    assert all(toxicity.features([w], toxicity.automaton(model.entries))[0][2] > 0 for w in ("idiott", "mor0n"))


def test_terms_outside_the_sample_are_learned(spark, monkeypatch):
    """A term in few of many toxic documents is found, however small the sample for the weights."""
    monkeypatch.setattr(toxicity, "SAMPLE", 40)
    docs = [(i, " ".join(words(i, 40)) + (" rarest" if i % 60 == 0 else " moron" if i % 6 == 0 else "")) for i in range(1500)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i, _ in docs], "doc_id long, toxic int")
    assert {"rarest", "moron"} <= set(toxicity.learn(rows, labels).entries)


def test_quotation_scores_lower_than_abuse(spark):
    """The same term, thrown at someone in toxic documents and quoted in clean ones."""
    docs, labels = [], []
    for i in range(900):
        text = words(i, 40)
        text[20] = "moron" if i % 4 == 0 else 'he said "moron" again' if i % 36 == 1 else text[20]
        docs.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0)))
    model = toxicity.learn(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    base = " ".join(words(5000, 30))
    tried = spark.createDataFrame([(1, base + " moron"), (2, base + ' he said "moron" again'), (3, base)], "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.scored(tried, model).collect()}
    assert score[1] > 0.9 and score[2] < 0.3 and score[3] <= score[2]


def test_toxicity_of_edges(spark, judged, edges, clashing, nothing):
    model = toxicity.learn(*judged)
    rows = toxicity.scored(edges, model).collect()
    assert len(rows) == len(edge_rows()) and all(0 <= r.score < 0.3 for r in rows)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (8, None), (77, 1)], "doc_id long, toxic int")
    assert toxicity.toxic_documents(clashing, labels).count() == len(edge_rows())
    assert toxicity.toxic_documents(nothing, labels).collect() == []
    assert {r.predicted for r in toxicity.toxic_documents(edges, labels.where("false")).collect()} == {0}
