"""SentencePiece encoding and decoding by a streaming Viterbi search (operator 1).

Characters are taken one by one. Every place keeps the best piece that ends there and where it begins, for the
places that the longest piece still reaches; no more of the text is held. As soon as the paths of all those
places go through one boundary, the ids before it are committed. In a BPE model a step is allowed only if
merging leaves its two pieces apart; then one path is left for each place, and its ids are the library's.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keydrift.llm.common import kept_by_worker, mapped, slices

SPACE = "▁"
#: Segments whose ids, and pairs whose verdicts, a worker remembers; longer segments are searched each time.
REMEMBERED, LONG = 400_000, 48
#: Before the first piece; a character in no piece, which joins nothing.
NOTHING, UNKNOWN = -1, -2


def segments(pieces: Iterable[str]) -> re.Pattern:
    """A run of spaces and the letters, or the other characters, that follow: no piece goes beyond its end.

    Letters that some piece joins with another character but a space are no letters here. Joins across an end would make
    a piece with the characters on its two sides, so what is on one side has no effect on the other's ids.
    """
    joined = {pair for piece in pieces for pair in zip(piece, piece[1:], strict=False)}
    letters = {c for pair in joined for c in pair if c.isalpha()}
    mixed = letters
    while mixed:
        mixed = {c for a, b in joined if (a in letters) != (b in letters) and a != SPACE for c in (a, b)} & letters
        letters = letters - mixed
    if not letters:
        return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+$")
    some = "".join(map(re.escape, sorted(letters)))
    return re.compile(f"{SPACE}*(?:[{some}]+|[^{SPACE}{some}]+)|{SPACE}+$")


class Codec:
    """Pieces of a BPE model with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        every = range(model.vocab_size())
        usual = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in usual}
        self.score = {model.id_to_piece(i): model.get_score(i) for i in usual}
        self.text = {i: model.id_to_piece(i) for i in usual}
        self.bytes = {int(model.id_to_piece(i)[1:-1], 16): i for i in every if model.is_byte(i)}
        self.longest = max(map(len, self.ids))
        texts = [model.id_to_piece(i).replace(SPACE, " ").encode() if i in self.text else b"" for i in every]
        for byte, i in self.bytes.items():
            texts[i] = bytes([byte])
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.joined = np.frombuffer(b"".join(texts), np.uint8)
        self.parts: dict[str, tuple[str, str] | None] = {}
        self.verdicts: dict[int, bool] = {}
        self.size = model.vocab_size()
        self.segments = segments(self.ids)
        #: Trie of the pieces from their last character back: the characters before, and the id of the piece that begins
        #: here or None. Pieces that joins never make are left out.
        self.ends: dict[str, list] = {}
        for piece, i in self.ids.items():
            if len(piece) == 1 or self.split(piece) is not None:
                node, place = self.ends, None
                for c in reversed(piece):
                    place = node.setdefault(c, [{}, None])
                    node = place[0]
                place[1] = i
        self.known: dict[str, bytes] = {}  # ids of segments; when full, it becomes the older generation
        self.older: dict[str, bytes] = {}

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two parts that the last join made a piece from; None for one character or what joins never make."""
        if piece not in self.parts:
            parts, last = list(piece), None
            while len(parts) > 1:
                best = max(
                    ((self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.score),
                    default=None,
                )
                if best is None:
                    last = None
                    break
                i = -best[1]
                last = (parts[i], parts[i + 1])
                parts[i : i + 2] = ["".join(last)]
            self.parts[piece] = last
        return self.parts[piece]

    def _apart(self, left: str, right: str) -> bool:
        """Whether BPE keeps two pieces apart. Their joins are undone from the last one back: at any time the two
        parts that face each other must not join before one of them goes into its neighbour on the far side."""
        score = self.score
        left_goes = right_goes = float("-inf")  # scores at which the facing parts join their neighbours
        while True:
            across = score.get(left + right)
            if across is not None and across > left_goes and across >= right_goes:
                return False
            a, b = self.split(left), self.split(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and score[left] < score[right]):
                left_goes, left = score[left], a[1]
            else:
                right_goes, right = score[right], b[0]

    def allowed(self, before: int, piece: int) -> bool:
        """Whether merging the texts of two pieces one after the other gives these two pieces."""
        if len(self.verdicts) >= REMEMBERED:
            self.verdicts.clear()
        verdict = self.verdicts[before * self.size + piece] = self._apart(self.text[before], self.text[piece])
        return verdict

    def search(self, text: str) -> Iterator[list[int]]:
        """The ids of a text without its dummy prefix, committed from left to right."""
        ends, longest, verdicts, size = self.ends, self.longest, self.verdicts, self.size
        base, done = 0, 0  # the place that index 0 of the lists stands for; the committed boundary
        ids: list[int] = [NOTHING]  # the piece that ends at each place: NOTHING, or UNKNOWN for one character
        back: list[int] = [0]  # where it begins
        n = len(text)
        for end in range(1, n + 1):
            found, begin, start, node = UNKNOWN, end - 1, end, ends
            while start > done:
                start -= 1
                place = node.get(text[start])
                if place is None:
                    break
                node, piece = place
                if piece is not None:
                    before = ids[start - base]
                    verdict = before < 0 or verdicts.get(before * size + piece)
                    if verdict is None:
                        verdict = self.allowed(before, piece)
                    if verdict:
                        found, begin = piece, start
                        break
            ids.append(found)
            back.append(begin)
            if end - done >= 2 * longest:
                # The last places are all that later pieces can follow: where do their paths meet?
                places = set(range(end - longest + 1, end + 1))
                while len(places) > 1:
                    top = max(places)
                    places.remove(top)
                    places.add(max(done, back[top - base]))
                meet = places.pop()
                if meet > done:
                    yield self._path(text, ids, back, base, done, meet)
                    del ids[: meet - base], back[: meet - base]
                    base, done = meet, meet
        yield self._path(text, ids, back, base, done, n)

    def _path(self, text: str, ids: list[int], back: list[int], base: int, done: int, end: int) -> list[int]:
        path: list[int] = []
        while end > done:
            begin = back[end - base]
            if ids[end - base] >= 0:
                path.append(ids[end - base])
            else:
                path += [self.bytes[b] for b in reversed(text[begin:end].encode("utf-8", "replace"))]
            end = begin
        return path[::-1]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit bytes."""
        if not text:
            return b""
        if len(self.known) >= REMEMBERED:
            self.known, self.older = {}, self.known
        known, out = self.known, []
        for segment in self.segments.findall(SPACE + text.replace(" ", SPACE)):
            ids = known.get(segment)
            if ids is None:
                ids = self.older.get(segment)
                if ids is None:
                    found = [i for ids in self.search(segment) for i in ids]
                    ids = struct.pack(f"<{len(found)}i", *found)
                if len(segment) <= LONG:
                    known[segment] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes of the pieces put together, the dummy prefix taken off."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        place = np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        text = self.joined[place].tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids for every row, repeated ones too; null and empty texts have no ids. Only doc_id and text are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept_by_worker(f"pieces {path}", lambda: Codec(path))
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [codec.encode(t) for t in part.column("text").fill_null("").to_pylist()]
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(mapped, run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """The rows (doc_id, ids) with their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept_by_worker(f"pieces {path}", lambda: Codec(path))
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                lists = part.column("ids").fill_null([])
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
                texts = [codec.decode(x) for x in np.split(flat, ends[:-1])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return rows.select("doc_id", "ids").transform(mapped, run, "doc_id long, ids array<int>, text string")
