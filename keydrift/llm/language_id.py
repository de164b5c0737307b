"""Language identification by a byte convolutional network (operator 3).

Filters of several widths slide over the bytes of fixed-length windows; each filter's maximum in the window
goes to a softmax over languages. The network is trained in numpy on a bounded sample of labelled windows.
A whole text is cut into windows, and their probabilities are averaged by the bytes they hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keydrift.llm.common import crc_fold, hashed_sample, mapped, slices, text_digest, utf8

#: Bytes of a window, widths of filters, filters of each width; languages that can't be told.
WINDOW, WIDTHS, FILTERS, UNKNOWN = 256, (2, 3, 4), 16, "und"
#: Labelled rows that the network is trained on at most, rounds over them, windows of a step.
SAMPLE, EPOCHS, STEP, RATE = 6000, 6, 64, 0.01
#: Windows that are convolved at a time.
BATCH = 512


@dataclass
class Network:
    """tables[i][k] is what byte b at place k adds to the filters of width WIDTHS[i]."""

    languages: list[str]
    tables: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray


def windows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts (n, WINDOW), the row each comes from, and the bytes of text in it; zeros follow a text's end."""
    data, at = utf8(texts)
    count = -(-np.diff(at) // WINDOW)
    row = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = at[row] + nth * WINDOW
    held = np.minimum(at[row + 1] - start, WINDOW)
    place = np.minimum(start[:, None] + np.arange(WINDOW), max(0, len(data) - 1))
    out = data[place] if len(data) else np.zeros((0, WINDOW), np.uint8)
    out[np.arange(WINDOW) >= held[:, None]] = 0
    return out, row, held


def _convolved(net: Network, batch: np.ndarray) -> np.ndarray:
    """(windows, places, filters): places that hold the widest filter, so that all widths see the same."""
    places = WINDOW - max(WIDTHS) + 1
    parts = []
    for width, table in zip(WIDTHS, net.tables, strict=True):
        parts.append(sum(table[k][batch[:, k : k + places]] for k in range(width)))
    return np.concatenate(parts, axis=2) + net.bias


class Fast:
    """The same maxima by tables over pairs of bytes, made once per task."""

    def __init__(self, net: Network):
        self.net = net
        pair = [(t[0][:, None, :] + t[1][None, :, :]).reshape(1 << 16, -1) for t in net.tables]
        self.first = np.concatenate(pair, axis=1).astype(np.float32)
        self.third = net.tables[1][2].astype(np.float32)
        self.last = (net.tables[2][2][:, None, :] + net.tables[2][3][None, :, :]).reshape(1 << 16, -1).astype(np.float32)

    def probabilities(self, batch: np.ndarray) -> np.ndarray:
        places = WINDOW - max(WIDTHS) + 1
        wide = batch.astype(np.int32)
        pairs = (wide[:, :-1] << 8) | wide[:, 1:]
        x = self.first[pairs[:, :places]]
        x[:, :, FILTERS : 2 * FILTERS] += self.third[batch[:, 2 : 2 + places]]
        x[:, :, 2 * FILTERS :] += self.last[pairs[:, 2 : 2 + places]]
        return _softmax(np.maximum(x.max(axis=1) + self.net.bias, 0) @ self.net.dense + self.net.offset)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def trained(texts: list[str], languages: list[str], seed: int = 3) -> Network:
    """A network fitted to windows of the texts by Adam. Windows are cut to random lengths, so short texts are known too."""
    random = np.random.default_rng(seed)
    names = sorted(set(languages))
    rows, row, held = windows(pa.array(texts, pa.string()))
    target = np.array([names.index(x) for x in languages])[row]
    net = Network(
        names, [random.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(FILTERS * len(WIDTHS), np.float32),
        random.normal(0, 0.2, (FILTERS * len(WIDTHS), len(names))).astype(np.float32), np.zeros(len(names), np.float32),
    )
    weights = [*net.tables, net.bias, net.dense, net.offset]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(EPOCHS):
        order = random.permutation(len(rows))
        for begin in range(0, len(order), STEP):
            pick = order[begin : begin + STEP]
            batch, step = rows[pick].copy(), step + 1
            keep = np.where(random.random(len(pick)) < 0.5, WINDOW, random.integers(6, WINDOW + 1, len(pick)))
            batch[np.arange(WINDOW) >= np.minimum(keep, held[pick])[:, None]] = 0
            x = _convolved(net, batch)
            top = x.argmax(axis=1)
            high = np.take_along_axis(x, top[:, None, :], axis=1)[:, 0, :]
            active = np.maximum(high, 0)
            loss = _softmax(active @ net.dense + net.offset)
            loss[np.arange(len(pick)), target[pick]] -= 1
            loss /= len(pick)
            back = (loss @ net.dense.T) * (high > 0)
            slopes = [np.zeros_like(t) for t in net.tables]
            for i, width in enumerate(WIDTHS):
                part = slice(i * FILTERS, (i + 1) * FILTERS)
                for k in range(width):
                    byte = np.take_along_axis(batch, top[:, part] + k, axis=1)
                    np.add.at(slopes[i][k], (byte, np.arange(FILTERS)[None, :]), back[:, part])
            slopes += [back.sum(axis=0), active.T @ loss, loss.sum(axis=0)]
            for w, g, m, v in zip(weights, slopes, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike("\\p{L}"), F.lit(False))


def learn(docs: DataFrame, rows: int = SAMPLE) -> Network | None:
    """Train on one window of each of at most `rows` labelled documents of the training folds, chosen by hash.

    The window's place in its text is chosen by hash as well. None where nothing is labelled.
    """
    known = docs.where(F.col("lang").isNotNull() & has_letter(F.col("text")) & (crc_fold(F.col("doc_id")) != 2))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1) + 1
    window = F.substring("text", place.cast("int"), F.lit(WINDOW)).alias("window")
    sample = hashed_sample(known.select("doc_id", "lang", window), rows, "doc_id", "lang", "window").collect()
    return trained([r.window for r in sample], [r.lang for r in sample]) if sample else None


def identified(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred, score, text_sha256 for every row: the language of the whole text, and its mean probability.

    Null texts and texts without a letter are `und` with score 0. Only doc_id and text are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fast = Fast(net) if net else None
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                languages, scores = [UNKNOWN] * n, np.zeros(n)
                if net and n:
                    rows, row, held = windows(part.column("text"))
                    mean = np.zeros((n, len(net.languages)))
                    for i in range(0, len(rows), BATCH):
                        at = slice(i, i + BATCH)
                        np.add.at(mean, row[at], fast.probabilities(rows[at]) * held[at, None])
                    mean /= np.maximum(mean.sum(axis=1, keepdims=True), 1e-12)
                    told = np.array(part.column("lettered").to_pylist(), bool)
                    best = mean.argmax(axis=1)
                    languages = [net.languages[b] if t else UNKNOWN for b, t in zip(best, told, strict=True)]
                    scores = np.where(told, np.clip(mean.max(axis=1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(languages, pa.string()), pa.array(scores, pa.float64()), part.column("text_sha256")],
                    names=["doc_id", "lang_pred", "score", "text_sha256"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", has_letter(F.col("text")).alias("lettered"), text_digest())
    return rows.transform(mapped, run, "doc_id long, lang_pred string, score double, text_sha256 string")


def languages(docs: DataFrame) -> DataFrame:
    """Learn from docs (doc_id, text, lang) and predict each row: doc_id, held_out, lang_pred, score,
    text_sha256 (which names the row where its doc_id does not).

    Learns from folds other than the held-out one only; rows are predicted one by one, repeated ones too. A null
    doc_id counts as the empty text for the fold.
    """
    return identified(docs, learn(docs)).select("doc_id", (crc_fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score", "text_sha256")
