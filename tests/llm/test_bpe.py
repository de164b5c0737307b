import random
import sys

import numpy as np
import public_tokenizers
import pytest
from llm_rows import edge_rows, rows_of
from tokenizers import Tokenizer

from keydrift.llm.bpe_codec import PairCodec, decoded, encoded

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return PairCodec(PATH)


def odd_texts(n, seed=3):
    draw = random.Random(seed)
    letters = [chr(c) for c in range(32, 127)] + list("éßЖ日한😀\x1c\x85 ​﻿́\n\t") + ["\U00010940", "\U0003d000"]
    letters += ["<|endoftext|>", "'s", "'re", "  ", "<|endo"]
    return ["".join(draw.choice(letters) for _ in range(draw.randrange(50))) for _ in range(n)]


def same(codec, library, texts):
    got = [np.frombuffer(x, "<i4") for x in codec.encode(texts)]
    for text, ids, want in zip(texts, got, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == want.ids, text
        assert codec.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_odd_texts_equal_the_library(codec, library):
    same(codec, library, odd_texts(3000))


def test_every_code_point_equals_the_library(codec, library):
    codes = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    same(codec, library, ["".join(f"a{chr(c)}1{chr(c)} {chr(c)}" for c in codes[i : i + 500]) for i in range(0, len(codes), 500)])


def test_long_words_equal_the_library(codec, library):
    draw = random.Random(1)
    same(codec, library, ["a" * 30_000, "ab" * 9_000, " " * 5_000 + "x", "".join(draw.choice("abcdef") for _ in range(20_000))])


def test_trees_together_equal_one_by_one(codec):
    draw = random.Random(2)
    words = [bytes(draw.randrange(256) if draw.random() < 0.2 else draw.choice(b"ethaoin ") for _ in range(draw.randrange(1, 90))) for _ in range(800)]
    for size in (8, 16, 64, 128):
        some = [w for w in words if len(w) < size]
        assert [np.frombuffer(x, "<i4").tolist() for x in codec.merged_together(some, size)] == [codec.merged(w) for w in some]


def test_words_forgotten_and_remembered(library, monkeypatch):
    import keydrift.llm.bpe_codec as module

    monkeypatch.setattr(module, "REMEMBERED", 40)
    codec = PairCodec(PATH)
    texts = odd_texts(400, seed=4)
    for i in range(0, 400, 20):
        same(codec, library, texts[i : i + 20] + texts[:5])
    assert len(codec.known) <= 40 + 25 * 50


def test_bytes_that_are_no_text(codec, library):
    for ids in ([200, 150, 50256, 65], [], [255, 0]):
        assert codec.decode(np.array(ids, int)) == library.decode(ids, skip_special_tokens=False)


def test_rows(spark, edges, clashing, nothing, library):
    rows = decoded(encoded(edges, PATH), PATH).collect()
    texts = sorted((str(r[0]), r[1] or "") for r in edge_rows())
    assert sorted((str(r.doc_id), r.text) for r in rows) == texts
    for r in rows:
        assert r.ids == library.encode(r.text, add_special_tokens=False).ids
    assert rows_of(encoded(clashing, PATH)) == rows_of(encoded(edges, PATH))
    assert decoded(encoded(nothing, PATH), PATH).count() == 0
