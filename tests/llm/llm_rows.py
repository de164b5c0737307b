import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n, stems=("ra", "mo", "ti", "len", "sku", "ova", "pre", "dor")):
    draw = random.Random(seed)
    return [draw.choice(stems) + draw.choice(stems) + draw.choice(stems) for _ in range(n)]


def edge_rows():
    """Nulls, empty and very long texts, ties, repeated rows and near copies."""
    long_text = "\n".join(" ".join(words(k, 400)) for k in range(30))
    base = words(1, 60)
    near = base[:30] + ["changed"] + base[31:]
    rows = [
        (1, " ".join(base), "en", "a", 1), (2, " ".join(near), "en", "a", 1), (3, " ".join(base), "en", "b", 1),
        (3, " ".join(base), "en", "b", 1), (4, None, None, None, None), (5, "", "en", "a", 0), (6, " ", "en", "a", 1),
        (7, long_text, "fr", "c", 9), (8, "one", "fr", None, 3), (9, "One", "fr", "c", 3), (10, "a\tb  c", None, "c", 6),
        (11, "a b c", "en", "c", 5), (None, "a b c", "en", "c", 5), (None, None, None, None, None),
        (12, "Été über 日本 😀\n\n…", "de", "d", 3), (13, "licensed under the MIT License. gnu general public license", "en", "a", 3),
        (14, "12 34 !", "en", "a", 3),
    ]
    return rows


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), DOCS).repartition(3).persist()


@pytest.fixture(scope="session")
def clashing(edges):
    """The same rows with columns of names that the operators use themselves."""
    more = ["row", "kept", "component_id", "class_key", "node", "hash", "place", "arc", "rank", "digest", "content", "locator",
            "arrival", "stays", "copies", "words", "hits", "label", "score", "lanes", "edited", "next_id", "toxic", "ids",
            "offset", "tree", "path", "held_out"]
    frame = edges
    for name in more:
        frame = frame.withColumn(name, edges["text"])
    return frame


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(frame):
    return sorted(map(repr, (tuple(r) for r in frame.collect())))
