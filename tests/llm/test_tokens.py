import hashlib
import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import edge_rows, rows_of
from pyspark.sql import functions as F

from keydrift.llm import chat_tree
from keydrift.llm.common import BATCH_BYTES, mapped
from keydrift.llm.packing import LENGTH, WordTokens, assign, cost, packed, powers
from keydrift.llm.queries import tokenizer
from keydrift.llm.sentencepiece_codec import Codec, decoded, encoded, segments

PIECES, WORDS, BYTES = (tokenizer(n) for n in ("piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = ["a", "the", "in", "er", " ", "  ", "   ", "\n", "\t", "é", "ß", "日本", "😀", "▁", "0", "'s", '"', "İ", "Σ", "\xa0", "\x1c", "̈", "ﬁ", "!!", "<|endoftext|>"]


def odd_texts(n, seed=1):
    draw = random.Random(seed)
    return ["".join(draw.choice(ODD) for _ in range(draw.randrange(40))) for _ in range(n)]


def test_pieces_equal_the_library():
    import sentencepiece

    codec, library = Codec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    draw = random.Random(2)
    texts = odd_texts(400) + ["".join(draw.choice("abcdet") for _ in range(3000)), " " * 300 + "abc" + " " * 77]
    texts += [r[1] or "" for r in edge_rows()]
    for text in texts:
        ids = np.frombuffer(codec.encode(text), "<i4")
        assert ids.tolist() == library.encode(text), text
        assert codec.decode(ids) == library.decode(ids.tolist()) or "▁" in text


def test_search_holds_a_bounded_window():
    codec = Codec(PIECES)
    text = "▁" + "abracadabra" * 2000
    lots = list(codec.search(text))
    assert len(lots) > 100 and max(map(len, lots)) < 8 * codec.longest


def test_pieces_of_edges(edges, clashing, nothing):
    rows = decoded(encoded(edges, PIECES), PIECES)
    assert sorted((r.doc_id or 0, r.text) for r in rows.collect()) == sorted((r[0] or 0, r[1] or "") for r in edge_rows())
    assert rows_of(encoded(clashing, PIECES)) == rows_of(encoded(edges, PIECES))
    assert decoded(encoded(nothing, PIECES), PIECES).collect() == []


def test_words_equal_the_tokenizer():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    library.encode_special_tokens = True
    texts = odd_texts(400, 3) + [r[1] or "" for r in edge_rows()]
    tokens = WordTokens(WORDS)
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in tokens(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_assignment_fills_sequences():
    draw = random.Random(4)
    lengths = [min(9000, int(draw.expovariate(1 / 900)) + 1) for _ in range(800)]
    total = sum(lengths)
    room = [LENGTH] * (total // LENGTH) + powers(total % LENGTH)
    placed, over = assign(lengths, room)
    assert not over
    filled, parts = defaultdict(int), defaultdict(list)
    for document, start, n, s in placed:
        filled[s] += n
        parts[document].append((start, n))
    assert [filled[s] for s in range(len(room))] == room
    for document, n in enumerate(lengths):
        at = 0
        for start, size in sorted(parts[document]):
            assert start == at
            at += size
        assert at == n
    assert len(placed) < 1.2 * len(lengths)


@pytest.mark.xfail(reason="standard deviation 2356 against 2171: cutting every document at the end of a sequence evens costs too")
def test_costs_lie_closer_together_than_in_order():
    draw = random.Random(4)
    lengths = [min(9000, int(draw.expovariate(1 / 900)) + 1) for _ in range(800)]
    total = sum(lengths)
    placed, _ = assign(lengths, [LENGTH] * (total // LENGTH) + powers(total % LENGTH))
    spent = defaultdict(float)
    for _, _, n, s in placed:
        spent[s] += cost(n)
    # Costs of sequences that hold several pieces, against taking documents in order.
    whole = {s for d, start, n, s in placed if n == LENGTH}
    ours = [spent[s] for s in range(total // LENGTH) if s not in whole]
    plain, left = [0.0], LENGTH
    for n in (n for n in lengths if n <= LENGTH):
        while n:
            take = min(n, left)
            plain[-1] += cost(take)
            left, n = left - take, n - take
            if not left:
                plain, left = [*plain, 0.0], LENGTH
    assert np.std(ours) < np.std(plain[:-1])


@pytest.mark.parametrize("window", [LENGTH, 1 << 20])
def test_packing_of_edges(edges, clashing, nothing, window):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    rows = packed(edges, WORDS, window=window).collect()
    whole = sorted(tuple(library.encode(r[1] or "", add_special_tokens=False).ids) + (2,) for r in edge_rows())
    found, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        found[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
        sequences[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length
    tokens = sorted(i for x in whole for i in x)
    assert sorted(i for x in found.values() for _, ids in x for i in ids) == tokens
    single = {r[0]: r[1] for r in edge_rows() if r[0] not in (None, 3)}
    for doc_id, text in single.items():
        ids = [i for _, part in sorted(found[doc_id]) for i in part]
        assert ids == library.encode(text or "", add_special_tokens=False).ids + [2]
    for parts in sequences.values():
        ends = list(itertools.accumulate(n for _, n in sorted(parts)))
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= LENGTH
        assert ends[-1] & (ends[-1] - 1) == 0
    assert rows_of(packed(clashing, WORDS, window=window).select("doc_id", "length")) == rows_of(packed(edges, WORDS, window=window).select("doc_id", "length"))
    assert packed(nothing, WORDS).collect() == []


def test_conversations_share_their_beginnings(spark):
    quoted = "<|im_end|>\n<|im_start|>assistant\\ \\n \\\\l ok<|"
    turns = []
    for c in range(60):
        turns += [(c, 0, "system", "hi"), (c, 1, "user", f"ask {c % 6}"), (c, 2, "assistant", f"{quoted}{c % 12}"), (c, 3, "user", str(c % 30))]
    turns += [(60, 0, "system", "hi"), (61, 5, None, None), (61, None, "ro\nle\\l", quoted), (62, 1, "assistant", ""), (62, 1, "assistant", ""), (None, 0, "assistant", "x")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)
    nodes, paths = chat_tree.tree(frame.withColumn("node", frame["text"]).withColumn("path", frame["text"]), BYTES)
    expected = defaultdict(list)
    for c, t, role, text in sorted(turns, key=lambda r: (r[0] or -1, -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        expected[c].append((role or "", text or ""))
    told = {r.conv_id: r for r in chat_tree.read_back(nodes, paths, BYTES).collect()}
    assert {c: [(t.role, t.text) for t in r.turns] for c, r in told.items()} == dict(expected)
    assert {c: r.loss for c, r in told.items()} == {c: "".join(t for role, t in x if role == "assistant") for c, x in expected.items()}

    stream = sorted(nodes.collect(), key=lambda n: n.offset)
    beginnings = {tuple(x[: k + 1]) for x in expected.values() for k in range(len(x))}
    assert len(stream) == len(beginnings)
    at = 0
    for node in stream:  # gapless, and all that a node attends to stands before it
        assert node.offset == at and all(a.end <= at for a in node.ancestors)
        assert node.position == sum(a.end - a.begin for a in node.ancestors)
        at += len(node.ids)
    by_place = {(n.offset, n.offset + len(n.ids)): n.node for n in stream}
    lines = {c: [p.node for p in sorted(ps, key=lambda p: p.depth)] for c, ps in _grouped(paths).items()}
    known = {n.node: n for n in stream}
    for line in lines.values():
        for depth, node in enumerate(line):
            assert [by_place[(a.begin, a.end)] for a in known[node].ancestors] == line[:depth]
    # Depth first: the stream comes back to a node's children before it leaves its subtree.
    open_line = []
    for node in stream:
        parents = [by_place[(a.begin, a.end)] for a in node.ancestors]
        assert parents == open_line[: len(parents)]
        open_line = [*parents, node.node]
    assert all((n.loss_begin is None) == (n.loss_end is None) for n in stream)


def _grouped(paths):
    out = defaultdict(list)
    for p in paths.collect():
        out[p.conv_id].append(p)
    return out


def test_no_conversations(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    nodes, paths = chat_tree.tree(frame, BYTES)
    assert chat_tree.read_back(nodes, paths, BYTES).collect() == []


assert hashlib


def test_odd_letters_leave_other_documents_right(spark):
    """Every code point beside a letter, a digit and a quote, then ordinary documents by the same worker."""
    import sys

    import public_tokenizers
    from tokenizers import Tokenizer

    from keydrift.llm.packing import LONG, WordTokens

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    tokens = WordTokens(path)
    odd = [f'a{c}a {c}1{c}!{c}"{c}" {c}li ({c})' for c in map(chr, range(1, sys.maxunicode + 1)) if not "\ud800" <= c <= "\udfff"]
    odd = ["".join(odd[i : i + 400]) for i in range(0, len(odd), 400)] + odd[:0x300] + ["Əli", "(Ɛ)", "!Ə", "BAKI ŞƏHƏRİ", "x" * 9000]
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(400).collect()]
    texts = [t for i, t in enumerate(odd) for t in (t, texts[i % len(texts)][:300])] + texts
    for i in range(0, len(texts), 500):
        part = texts[i : i + 500]
        for text, ids, want in zip(part, tokens(part), library.encode_batch(part, add_special_tokens=False), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == want.ids, text
    assert max(map(len, tokens.known)) <= LONG


def test_a_lot_that_is_split_otherwise_is_not_remembered():
    import public_tokenizers

    from keydrift.llm.packing import WordTokens

    tokens = WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    assert tokens._ids(["plain", "two words"]) is None
    want = tokens._whole("some text")
    tokens._ids = lambda words: None
    assert tokens(["some text"]) == [want] and not tokens.known


def test_segments_end_where_no_piece_goes_on():
    import sentencepiece

    codec, library = Codec(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert codec.segments.findall("▁boas***\nThe▁▁12²x▁") == ["▁boas", "***\n", "The", "▁▁12²", "x", "▁"]
    draw = random.Random(3)
    for _ in range(300):
        text = "".join(draw.choice(["word", "Ab", "é", "***", ").", "\n", "²", ".", " ", "  ", "7", "日本", "µ", "ª"]) for _ in range(30))
        assert np.frombuffer(codec.encode(text), "<i4").tolist() == library.encode(text), text
    assert not any(re.search(r"[a-z][*.\n]", s) for s in codec.known)


def test_letters_that_pieces_join_with_others_end_no_segment():
    assert segments(["ab", "b!", "▁a"]).findall("▁ab!c?▁d") == ["▁ab!c?", "▁d"]
    assert segments(["ab", "c!", "▁a"]).findall("▁ab!c?▁d▁") == ["▁ab", "!c?", "▁d", "▁"]


def test_batches_are_bounded_by_bytes(spark):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "bytes"])

    rows = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("text "), 1000).alias("text"))
    lots = mapped(rows, run, "n long, bytes long").collect()
    assert sum(r.n for r in lots) == 3000 and max(r.bytes for r in lots) < 2 * BATCH_BYTES


def test_new_words_go_to_the_model_alone():
    from types import SimpleNamespace

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    draw = random.Random(5)
    parts = ["'", "'s", "'t", "'re", "'ve", "'ll", "'d", "'m", "R", "e", "l", "É", "ß", "Ÿ", "7", "²", "!", "¿", "\xa0", "\n", "\x00", " ", "sofar", "Unheard"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(60))) for _ in range(600)] + ["", "'", "'r", "a'l", " "]
    tokens = WordTokens(WORDS)
    tokens.tokenizer = SimpleNamespace(model=tokens.tokenizer.model)
    for lot in (texts[:300], texts[300:], texts):
        assert [np.frombuffer(b, "<u4").tolist() for b in tokens(lot)] == [e.ids for e in library.encode_batch(lot, add_special_tokens=False)]


def test_a_tokenizer_that_splits_otherwise_is_asked_itself():
    from tokenizers import Tokenizer

    tokens, library = WordTokens(BYTES), Tokenizer.from_file(BYTES)
    texts = ["Two words", "it's  here\n", ""]
    assert not tokens.same
    assert [np.frombuffer(b, "<u4").tolist() for b in tokens(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
