"""Cost-balanced packing of documents into training sequences (operator 5).

The cost of a piece is estimated as its tokens plus a share of their square, for attention within it. Pieces go
in descending order to the sequence of lowest cost that still has room; where none has room, a piece is cut.
Every task packs what it reads in windows of bounded size: tokens are made once, never shuffled or gathered.
As many sequences are opened as the window's tokens fill; the few tokens left over go to the task's next
window, and at its end to sequences whose lengths are powers of two, so that nothing is padded.
"""

from __future__ import annotations

import heapq
import itertools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keydrift.llm.common import kept_by_worker, mapped, slices

#: Tokens of a sequence; the id that ends a document; tokens that a task holds before it packs them.
LENGTH, END, WINDOW = 4096, 2, 1 << 20
#: Pieces that a task hands on at a time.
GIVEN = 256
#: Cost of a piece of n tokens: n + QUADRATIC * n * n.
QUADRATIC = 1 / 1024
#: Words of at most LONG characters whose ids a worker remembers (some 200 bytes each), and bytes of text whose words
#: are looked up together.
REMEMBERED, LONG, TOGETHER = 80_000, 64, 200_000

_LETTERS, _DIGITS = "a-zªµºß-öø-ſ", "0-9²³¹¼-¾"
#: Texts of other characters are left to the tokenizer; the lower case of these is one of the letters again.
OTHER = re.compile("[^\\x00-\\x1b\\x20-\\x7f\\xa0-\\u012f\\u0131-\\u017f]")
SPACE, LETTER, DIGIT, SIGN = range(4)
#: The kind of every character in lower case, by code point.
KINDS = np.array(
    [
        next(kind for kind, of in enumerate(["\\s", f"[{_LETTERS}]", f"[{_DIGITS}]", "."]) if re.match(of, chr(c), re.S))
        for c in range(0x180)
    ],
    np.uint8,
)


def split(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The tokenizer's own split, 's|'t|'re|'ve|'m|'ll|'d|letters|digit|signs, of texts in lower case and UTF-8: all
    words, and how many of them there are up to the end of each text."""
    joined = b"\n".join([*texts, b"\n\n"])  # three bytes follow the last character
    data = np.frombuffer(joined, np.uint8)
    kind = KINDS[data]
    lead = np.flatnonzero(data >= 0xC0)  # two bytes a character
    kind[lead] = kind[lead + 1] = KINDS[(data[lead] & np.uint16(0x1F)) << 6 | data[lead + 1] & 0x3F]
    begins = kind == DIGIT
    begins[0] = True
    begins[1:] |= kind[1:] != kind[:-1]
    begins[lead + 1] = False
    quote = np.flatnonzero(data == ord("'"))
    quote = quote[begins[quote] & (kind[quote + 1] == LETTER)]
    first, second = data[quote + 1], data[quote + 2]
    short = np.isin(first, list(b"stmd"))
    long = (np.isin(first, list(b"rv")) & (second == ord("e"))) | ((first == ord("l")) & (second == ord("l")))
    begins[quote[short | long] + 1] = False
    begins[quote[short] + 2] = True
    begins[quote[long] + 3] = True
    inside = kind != SPACE
    places = np.append(np.flatnonzero(begins[inside]), np.count_nonzero(inside))
    words = pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(places), pa.py_buffer(data[inside]))
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    return words, np.searchsorted(np.flatnonzero(begins & inside), ends)


class WordTokens:
    """Token ids of texts as little-endian 32-bit bytes, equal to the tokenizer's; words are looked up first."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        by_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: by_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0x180) if KINDS[c] != SPACE}
        self.known: dict[str, bytes] = {}
        # Where a word ends depends on the kinds of two characters, and on two characters behind a quote.
        probe = [f"a{c}a{c}1{c}!{c}{c} {c}" for c in map(chr, range(0x180)) if not OTHER.search(c)]
        probe += [f"{a}'{b}{c}{d}" for a in ["", "a", "1", "!"] for b in "strevmldé'1 " for c in "evlaé'1 " for d in "sé'"]
        self.same = self._plain(probe) == [self._whole(t) for t in probe]  # else texts are left to the tokenizer
        self.known.clear()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, words: list[str]) -> dict[str, bytes] | None:
        """Ids of each of the words by the tokenizer's model; None if one of them has spaces."""
        pieces = " ".join(words).translate(self.letters).split(" ")
        if len(pieces) != len(words):
            return None
        model = self.tokenizer.model
        ids = ([t.id for t in model.tokenize(piece)] for piece in pieces)
        return {w: struct.pack(f"<{len(x)}I", *x) for w, x in zip(words, ids, strict=True)}

    def _plain(self, texts: list[str]) -> list[bytes]:
        words, ends = split([t.lower().encode() for t in texts])
        lot = words.dictionary_encode()
        distinct = lot.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, distinct))
        new = [w for w, ids in zip(distinct, found, strict=True) if ids is None]
        extra = self._ids(new) if new else {}
        if extra is None:
            return [self._whole(t) for t in texts]
        if len(self.known) < REMEMBERED:
            self.known.update((w, ids) for w, ids in extra.items() if len(w) <= LONG)
        found = [extra[w] if ids is None else ids for w, ids in zip(distinct, found, strict=True)]
        # The ids of the distinct words, one word after the other, are copied to where each word stands.
        index, sizes = lot.indices.to_numpy(), np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin, n = (np.cumsum(sizes) - sizes)[index], sizes[index]
        after = np.append(0, np.cumsum(n))
        ids = np.frombuffer(b"".join(found), "<u4")[np.arange(after[-1]) + np.repeat(begin - after[:-1], n)]
        return [ids[a:b].tobytes() for a, b in itertools.pairwise(after[np.append(0, ends)].tolist())]

    def __call__(self, texts: list[str]) -> list[bytes]:
        odd = [not self.same or bool(OTHER.search(t)) for t in texts]
        plain = iter(self._plain([t for t, other in zip(texts, odd, strict=True) if not other]))
        return [self._whole(t) if other else next(plain) for t, other in zip(texts, odd, strict=True)]


def cost(tokens: int) -> float:
    return tokens + QUADRATIC * tokens * tokens


def assign(lengths: list[int], room: list[int]) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int, int]]]:
    """Pieces (document, start, tokens, sequence) in the order in which they are placed, and what no room is left
    for (document, start, tokens). Documents longer than the largest room are cut to it first."""
    most = max(room, default=0)
    pieces = []
    for i, n in enumerate(lengths):
        whole = n // most * most if most else 0
        pieces += [(i, s, most) for s in range(0, whole, most)] + ([(i, whole, n - whole)] if n > whole else [])
    pieces.sort(key=lambda p: (-p[2], p[0], p[1]))
    left = list(room)
    cheap = [(0.0, s) for s in range(len(room))]
    heapq.heapify(cheap)
    tight: list[tuple[int, float, int]] = []  # sequences without room for the piece before, most room first
    placed, over = [], []
    for document, start, n in pieces:
        while n:
            while tight and -tight[0][0] >= n:
                _, spent, s = heapq.heappop(tight)
                heapq.heappush(cheap, (spent, s))
            while cheap and left[cheap[0][1]] < n:
                spent, s = heapq.heappop(cheap)
                heapq.heappush(tight, (-left[s], spent, s))
            take = n
            if cheap:
                spent, s = heapq.heappop(cheap)
            elif tight and tight[0][0]:
                _, spent, s = heapq.heappop(tight)
                take = left[s]
            else:
                over.append((document, start, n))
                break
            placed.append((document, start, take, s))
            left[s] -= take
            if left[s]:
                heapq.heappush(cheap, (spent + cost(take), s))
            start, n = start + take, n - take
    return placed, over


def powers(tokens: int) -> list[int]:
    """Sequence lengths for a rest: the powers of two that add up to it."""
    return [1 << b for b in reversed(range(tokens.bit_length())) if tokens >> b & 1]


NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def packed(docs: DataFrame, path: str, length: int = LENGTH, window: int = WINDOW, end: int = END) -> DataFrame:
    """The pieces of every row: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    Null and empty texts have one token, the one that ends a document. Repeated rows are packed one by one, a
    null doc_id stays null. sequence_id names the task's partition in its high bits, so that a task that runs
    again writes the same sequences. Columns but doc_id and text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = kept_by_worker(f"words {path}", lambda: WordTokens(path))
        number = TaskContext.get().partitionId() << 32
        last = np.array([end], "<u4").tobytes()
        held: list[tuple] = []  # doc_id, tokens of the document, start, ids
        count = 0

        def emit(room: list[int]) -> Iterator[pa.RecordBatch]:
            nonlocal held, number
            placed, over = assign([len(x[3]) // 4 for x in held], room)
            filled = [0] * len(room)
            rows = []
            for i, begin, n, s in placed:
                doc_id, total, start, ids = held[i]
                rows.append((doc_id, start + begin, n, ids[4 * begin : 4 * (begin + n)], total, number + s, filled[s]))
                filled[s] += n
            number += len(room)
            held = [(held[i][0], held[i][1], held[i][2] + begin, held[i][3][4 * begin : 4 * (begin + n)]) for i, begin, n in over]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            for i in range(0, len(rows), GIVEN):
                columns = [pa.array(c, t) for c, t in zip(zip(*rows[i : i + GIVEN], strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=NAMES)

        def take(rows: list[tuple[int | None, str]]) -> None:
            nonlocal count
            for (doc_id, _), ids in zip(rows, tokens([text for _, text in rows]), strict=True):
                held.append((doc_id, len(ids) // 4 + 1, 0, ids + last))
                count += len(ids) // 4 + 1

        waiting: list[tuple[int | None, str]] = []
        size = 0
        for batch in batches:
            for part in slices(batch, "text"):
                waiting += zip(part.column("doc_id").to_pylist(), part.column("text").fill_null("").to_pylist(), strict=True)
                size += part.column("text").nbytes
                if size >= TOGETHER:
                    take(waiting)
                    waiting, size = [], 0
                if count >= window:
                    yield from emit([length] * (count // length))
                    count %= length
        take(waiting)
        yield from emit([length] * (count // length) + powers(count % length))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.transform(mapped, run, SCHEMA)
