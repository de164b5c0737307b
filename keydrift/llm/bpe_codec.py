"""Byte-pair encoding by a segment tree over adjacent pairs, and decoding (operator 11).

A text is split into words as the vocabulary's pre-tokenizer does. Over the bytes of a word stands a segment tree
whose leaves hold rank and place of each adjacent pair: its root is the leftmost pair of lowest rank. A merge
changes three leaves, each repaired along its path to the root, until no pair can be merged. Workers remember
short words, so that a common word is merged once.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keydrift.llm.common import kept_by_worker, mapped, slices

#: Words of at most LONG characters are remembered, so many of them in each of two generations (some 300 bytes each).
REMEMBERED, LONG = 100_000, 48
#: From so many bytes on a word's tree lies in flat arrays of numbers.
FLAT = 2_000
#: Words whose trees have one size are merged together from so many on, in lots of so many leaves.
TOGETHER, CELLS = 8, 1 << 18
NONE = 1 << 62
# Fixed value: how byte-level vocabularies split a text into words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The letter by which a byte-level vocabulary writes each byte: printable Latin-1 as it is, others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)]


def unassigned() -> np.ndarray:
    """Which code points have no category here; libraries of other Unicode versions may give them one."""
    return np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


class PairCodec:
    """Ids of texts and texts of ids, equal to the tokenizers library's for a byte-level vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        vocabulary, letters = stored["model"]["vocab"], byte_letters()
        self.byte_ids = [vocabulary[c] for c in letters]
        self.ranks: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(stored["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocabulary[left], vocabulary[right]] = rank
            self.made.append(vocabulary[left + right])
        self.byte_array, self.made_array, self.count = np.array(self.byte_ids), np.array(self.made), len(vocabulary) + 1
        keys = np.array([left * self.count + right for left, right in self.ranks])
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array(list(self.ranks.values()))[order]
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.split, self.doubtful = regex.compile(SPLIT), unassigned()
        self.library = Tokenizer.from_file(path).pre_tokenizer
        value = {c: b for b, c in enumerate(letters)}
        texts = [b""] * (1 + max(max(vocabulary.values()), max(self.special.values(), default=0)))
        for token, i in vocabulary.items():
            texts[i] = bytes(value[c] for c in token)
        for token, i in self.special.items():
            texts[i] = token.encode()
        self.sizes = np.array([len(t) for t in texts])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.joined = np.frombuffer(b"".join(texts), np.uint8)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merged(self, word: bytes) -> list[int]:
        """Ids of a word: its bytes, merged pair by pair."""
        n, ranks = len(word), self.ranks
        ids = [self.byte_ids[b] for b in word]
        if n < 2:
            return ids
        size = 1 << (n - 2).bit_length()
        tree = [NONE] * (2 * size)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        if n >= FLAT:
            ids, tree, after, before = array("l", ids), array("q", tree), array("l", after), array("l", before)
        for i in range(n - 1):
            rank = ranks.get((ids[i], ids[i + 1]))
            if rank is not None:
                tree[size + i] = rank * n + i
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] < NONE:
            rank, i = divmod(tree[1], n)
            gone = after[i]
            end = after[gone]
            ids[i], ids[gone], after[i] = self.made[rank], -1, end
            changed = [(i, NONE)]
            if end < n:
                before[end] = i
                rank = ranks.get((ids[i], ids[end]))
                changed = [(i, NONE if rank is None else rank * n + i), (gone, NONE)]
            elif gone < n - 1:
                changed.append((gone, NONE))
            i, begin = before[i], i
            if i >= 0:
                rank = ranks.get((ids[i], ids[begin]))
                changed.append((i, NONE if rank is None else rank * n + i))
            for leaf, key in changed:
                node = size + leaf
                tree[node] = key
                while node > 1:
                    node >>= 1
                    left, right = tree[2 * node], tree[2 * node + 1]
                    least = left if left < right else right
                    if tree[node] == least:
                        break
                    tree[node] = least
        return [i for i in ids if i >= 0]

    def _rank_keys(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
        """The leaves of pairs at their places: rank * size + place, NONE where they don't merge."""
        wanted = left * self.count + right
        at = np.minimum(np.searchsorted(self.pair_keys, wanted), len(self.pair_keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.pair_keys[at] == wanted), self.pair_ranks[at] * size + place, NONE)

    def merged_together(self, words: list[bytes], size: int) -> list[bytes]:
        """Ids of words of fewer bytes than size (a power of two), each with a tree of its own; all trees take a step
        at once. The last place of every row stays empty: it stands before the first piece and after the last one."""
        rows, empty = len(words), size - 1
        lengths = np.array([len(w) for w in words])
        column = np.arange(size)
        inside = column < lengths[:, None]
        ids = np.full((rows, size), -1, np.int64)
        ids[inside] = self.byte_array[np.frombuffer(b"".join(words), np.uint8)]
        after = np.where(column + 1 < lengths[:, None], column + 1, empty)
        before = np.broadcast_to(np.where(column > 0, column - 1, empty), (rows, size)).copy()
        tree = np.full((rows, 2 * size), NONE, np.int64)
        tree[:, size : 2 * size - 1] = self._rank_keys(ids[:, :-1], ids[:, 1:], column[:-1], size)
        level = size
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        at = np.flatnonzero(tree[:, 1] < NONE)
        while len(at):
            rank, i = np.divmod(tree[at, 1], size)
            gone = after[at, i]
            end = after[at, gone]
            ids[at, i], ids[at, gone], after[at, i] = self.made_array[rank], -1, end
            before[at, end] = i
            begin = before[at, i]
            leaves = np.stack([gone, i, begin], axis=1)
            piece = ids[at, i]
            tree[at, size + gone] = NONE
            tree[at, size + i] = self._rank_keys(piece, ids[at, end], i, size)
            tree[at, size + begin] = self._rank_keys(ids[at, begin], piece, begin, size)
            node, row = leaves + size, at[:, None]
            for _ in range(size.bit_length() - 1):
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
            at = at[tree[at, 1] < NONE]
        left = ids >= 0
        flat, ends = ids[left].astype("<i4").tobytes(), 4 * np.cumsum(left.sum(axis=1))
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _new(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words by the size of their trees; sizes that few words have are merged word by word."""
        out: dict[str, bytes] = {}
        sizes: dict[int, list[str]] = {}
        for word in words:
            ids = self.older.get(word)
            if ids is None:
                sizes.setdefault(max(8, 1 << len(word.encode()).bit_length()), []).append(word)
            else:
                out[word] = ids
        for size, group in sizes.items():
            if len(group) < TOGETHER:
                out.update((w, np.array(self.merged(w.encode()), "<i4").tobytes()) for w in group)
                continue
            step = max(1, CELLS // size)
            for i in range(0, len(group), step):
                part = group[i : i + step]
                out.update(zip(part, self.merged_together([w.encode() for w in part], size), strict=True))
        return out

    def _parts(self, text: str) -> Iterator[tuple[list[str], bytes]]:
        """Runs of words and the special token after each."""
        at = 0
        for found in self.specials.finditer(text) if self.specials else ():
            yield self._words(text[at : found.start()]), self.special[found.group()].to_bytes(4, "little")
            at = found.end()
        yield self._words(text[at:] if at else text), b""

    def _words(self, text: str) -> list[str]:
        if not text.isascii() and self.doubtful[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return self.split.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit bytes. Strings of special tokens have their ids, as in the library."""
        parts = [list(self._parts(text)) for text in texts]
        known = self.known
        new = {w for runs in parts for words, _ in runs for w in words if w not in known}
        extra = self._new(list(new))
        if len(known) + len(extra) > REMEMBERED:
            self.older = {w: i for w, i in known.items() if len(w) <= LONG}
            known = self.known = {}
            ids_of = lambda w: extra.get(w) or self.older[w]
        else:
            ids_of = lambda w: known.get(w) or extra[w]
        out = [b"".join([x for words, last in runs for x in (*map(ids_of, words), last)]) for runs in parts]
        known.update((w, i) for w, i in extra.items() if len(w) <= LONG)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        place = np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.joined[place].tobytes().decode("utf-8", "replace")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids for every row, repeated ones too; null and empty texts have no ids, a null doc_id stays null.

    Only doc_id and text are read. Rows are encoded where they are read: nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept_by_worker(f"pairs {path}", lambda: PairCodec(path))
        for batch in batches:
            for part in slices(batch, "text"):
                ids = codec.encode(part.column("text").fill_null("").to_pylist())
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(mapped, run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """The rows (doc_id, ids) with the text of their ids; null ids count as none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept_by_worker(f"pairs {path}", lambda: PairCodec(path))
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                lists = part.column("ids").fill_null([])
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
                texts = [codec.decode(x) for x in np.split(flat, ends[:-1])]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return rows.select("doc_id", "ids").transform(mapped, run, "doc_id long, ids array<int>, text string")
