"""Hard negatives by bounds along spanning trees of anchors (operator 13).

Anchors lie in blocks, each with a minimum spanning tree of its own. Down an edge of the tree a candidate's score
changes by at most the edge's length times the candidate's norm, so the score at the parent bounds the one at the
child; only candidates whose bounds reach the window that is looked for are scored again. Candidates lie in chunks,
and every chunk meets every block once for the positives and once for the negatives of their windows. Both meet in
groups, so that a task reads a share of the chunks, and keeps the best few of an anchor before they are shuffled.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keydrift.llm.common import mapped, saved

#: Vectors of a chunk of candidates and of a block of anchors; blocks whose best rows a task keeps at a time.
CHUNK, BLOCK, HELD = 2048, 128, 64
#: Chunks of a group, every block of anchors being read once by each group; and packs of a file.
GROUP, FILE = 4, 8
#: Positives of an anchor, negatives of each positive, and the share of the positive score they start at (percent).
POSITIVES, NEGATIVES, LEAST = 5, 5, 80
#: Scores up to here are exact in doubles; larger ones are reckoned in whole numbers.
EXACT = float(1 << 52)
PACKED = "number long, ids binary, labels binary, vectors binary, n int, dim int"


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label, vector (doubles) of the rows that take part: no null label, vector, component or id, all finite."""
    rows = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"),
    )
    whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).where(whole)


def _pack(rows: list[tuple[int, int, np.ndarray]], number: int) -> dict:
    dim = max(len(v) for _, _, v in rows)
    vectors = np.zeros((len(rows), dim))
    for i, (_, _, v) in enumerate(rows):
        vectors[i, : len(v)] = v
    ids, labels = (np.array([r[k] for r in rows], "<i8").tobytes() for k in (0, 1))
    return {"number": number, "ids": ids, "labels": labels, "vectors": vectors.tobytes(), "n": len(rows), "dim": dim}


def packs(rows: DataFrame, size: int) -> DataFrame:
    """vec_id, label, vector in packs of at most so many rows, as they lie in their partitions."""
    types = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]
    schema = pa.schema(list(zip(("number", "ids", "labels", "vectors", "n", "dim"), types, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []
        for batch in batches:
            lists = batch.column("vector")
            values, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
            held += zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), np.split(values, np.cumsum(sizes)[:-1]), strict=True)
            while len(held) >= size:
                yield pa.RecordBatch.from_pylist([_pack(held[:size], number)], schema)
                held, number = held[size:], number + 1
        if held:
            yield pa.RecordBatch.from_pylist([_pack(held, number)], schema)

    return mapped(rows, run, PACKED)


class Pack:
    """Vectors of a pack, padded with zeros, with their ids and labels."""

    def __init__(self, row: dict):
        self.ids, self.labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
        self.vectors = np.frombuffer(row["vectors"]).reshape(row["n"], row["dim"])
        self.norms = np.sqrt((self.vectors**2).sum(axis=1)) if len(self.ids) else np.zeros(0)


def spanning_tree(vectors: np.ndarray) -> list[tuple[int, int, float]]:
    """Edges (anchor, parent, length) of a minimum spanning tree, parents first; the root has the least total distance."""
    n = len(vectors)
    squares = (vectors**2).sum(axis=1)
    far = np.sqrt(np.maximum(squares[:, None] + squares[None] - 2 * vectors @ vectors.T, 0))
    root = int(far.sum(axis=1).argmin())
    edges, near, parent = [(root, -1, 0.0)], far[root].copy(), np.full(n, root)
    left = np.ones(n, bool)
    left[root] = False
    while left.any():
        nxt = int(np.where(left, near, np.inf).argmin())
        length = float(np.sqrt(((vectors[nxt] - vectors[parent[nxt]]) ** 2).sum()))
        edges.append((nxt, int(parent[nxt]), length))
        left[nxt] = False
        closer = far[nxt] < near
        near[closer], parent[closer] = far[nxt][closer], nxt
    return edges


def products(vectors: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers: exact doubles, or Python's integers, cut to 64 bits, where those don't do."""
    dim = min(vectors.shape[1], len(anchor))
    vectors, anchor = vectors[:, :dim], anchor[:dim]
    if not len(vectors) or np.abs(vectors).max(initial=0) * np.abs(anchor).max(initial=0) * dim < EXACT:
        return (vectors @ anchor).astype(np.int64)
    whole = [int(x) for x in anchor]
    sums = [sum(int(x) * y for x, y in zip(row, whole, strict=True)) for row in vectors.tolist()]
    return np.array([max(-(1 << 63), min((1 << 63) - 1, s)) for s in sums], np.int64)


def walk(block: Pack, edges: list[tuple[int, int, float]], chunk: Pack, wanted: Callable, take: Callable) -> int:
    """Score a chunk of candidates at a block's anchors, from each anchor to its children in the tree.

    wanted(anchor, low, high) tells which candidates with scores between these bounds must be scored, and
    take(anchor, places, scores) gets the scores. Returns how many were scored.
    """
    bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    children = np.bincount([p for _, p, _ in edges if p >= 0], minlength=len(edges))
    scored = 0
    for anchor, parent, length in edges:
        if parent < 0:
            low = np.full(len(chunk.ids), -np.inf)
            high = -low
            places = np.arange(len(chunk.ids))  # the root has no parent: all are scored
        else:
            # A little wider, for the rounding of lengths and norms.
            reach = length * chunk.norms * (1 + 1e-9) + 1
            low, high = bounds[parent][0] - reach, bounds[parent][1] + reach
            children[parent] -= 1
            if not children[parent]:
                del bounds[parent]
            places = np.flatnonzero(wanted(anchor, low, high))
        scores = products(chunk.vectors[places], block.vectors[anchor])
        scored += len(places)
        low[places] = high[places] = scores
        if children[anchor]:
            bounds[anchor] = low, high
        take(anchor, places, scores)
    return scored


class Best:
    """The best few (score descending, id ascending) under each key."""

    def __init__(self, most: int):
        self.most, self.rows = most, {}

    def least(self, key: tuple) -> float:
        """The score that a new row must reach."""
        rows = self.rows.get(key, ())
        return rows[-1][0] if len(rows) == self.most else -np.inf

    def add(self, key: tuple, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.most:
            # Those that surely are not among the best go first, without sorting.
            cut = np.partition(scores, len(scores) - self.most)[len(scores) - self.most]
            scores, ids = scores[scores >= cut], ids[scores >= cut]
        rows = self.rows.get(key, []) + list(zip(scores.tolist(), ids.tolist(), strict=True))
        if rows:
            self.rows[key] = sorted(rows, key=lambda r: (-r[0], r[1]))[: self.most]


FOUND = pa.schema([("block", pa.int64()), ("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("other_id", pa.int64()), ("score", pa.int64()), ("scored", pa.int64())])
FOUND_SCHEMA = "block long, anchor_id long, positive_id long, positive_score long, other_id long, score long, scored long"


def _met(chunks: DataFrame, blocks: DataFrame, step: Callable, most: int) -> DataFrame:
    """Every chunk with every block, group by group. Bests are kept for HELD blocks of a task and leave before its
    end only when more of them turn up. A last row without anchor tells how many scores the task reckoned."""
    groups = max(1, -(-chunks.count() // GROUP))
    left = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), *[F.col(c).alias(f"a_{c}") for c in blocks.columns])
    right = chunks.withColumn("group", F.pmod(F.xxhash64("number"), F.lit(groups)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, tuple[Pack, list, Best, dict]] = OrderedDict()
        scored = 0

        def leave(number: int, best: Best) -> pa.RecordBatch:
            rows = [(number, *key, i, s, 0) for key, rows in best.rows.items() for s, i in rows]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 7, schema=FOUND)

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                number = row["a_number"]
                if number not in held:
                    if len(held) >= HELD:
                        first, (_, _, best, _) = held.popitem(last=False)
                        yield leave(first, best)
                    block = Pack({k.removeprefix("a_"): v for k, v in row.items() if k.startswith("a_")})
                    held[number] = block, spanning_tree(block.vectors), Best(most), row
                held.move_to_end(number)
                block, edges, best, extra = held[number]
                scored += step(block, edges, Pack(row), best, extra)
        for number, (_, _, best, _) in held.items():
            yield leave(number, best)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (None, None, None, None, None, None, scored)], schema=FOUND)

    # The files of the blocks tell nothing of their repeats, so neither side is broadcast whatever its estimated size.
    return left.join(right.hint("merge"), "group").drop("group").transform(mapped, run, FOUND_SCHEMA)


def _positives(block: Pack, edges: list, chunk: Pack, best: Best, _: dict) -> int:
    def eligible(anchor: int) -> np.ndarray:
        return (chunk.labels == block.labels[anchor]) & (chunk.ids != block.ids[anchor])

    def key(anchor: int) -> tuple:
        return int(block.ids[anchor]), None, None

    def take(anchor: int, places: np.ndarray, scores: np.ndarray) -> None:
        ok = eligible(anchor)[places] & (scores >= best.least(key(anchor)))
        best.add(key(anchor), scores[ok], chunk.ids[places[ok]])

    return walk(block, edges, chunk, lambda a, low, high: eligible(a) & (high >= best.least(key(a))), take)


def _negatives(block: Pack, edges: list, chunk: Pack, best: Best, row: dict) -> int:
    windows: dict[int, list[tuple[int, int]]] = {}
    for w in row["a_windows"]:
        windows.setdefault(w["anchor_id"], []).append((w["positive_id"], w["positive_score"]))

    def of(anchor: int) -> list[tuple[tuple, float, int]]:
        """Keys and ends of the windows, raised to what a new row must reach."""
        name = int(block.ids[anchor])
        out = []
        for positive, score in windows.get(name, ()):
            key = name, positive, score
            out.append((key, max(-(-LEAST * score // 100), best.least(key)), score))
        return out

    def wanted(anchor: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        other, reached = chunk.labels != block.labels[anchor], np.zeros(len(low), bool)
        for _, least, most in of(anchor):
            reached |= (high >= least) & (low <= most)
        return other & reached

    def take(anchor: int, places: np.ndarray, scores: np.ndarray) -> None:
        other = chunk.labels[places] != block.labels[anchor]
        for key, least, most in of(anchor):
            ok = other & (scores >= least) & (scores <= most)
            best.add(key, scores[ok], chunk.ids[places[ok]])

    return walk(block, edges, chunk, wanted, take)


def _ranked(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The best of all tasks' bests, with their rank."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "other_id")
    return found.where("anchor_id is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _anchors(rows: DataFrame) -> DataFrame:
    """One row of each id."""
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.label", "row.vector")


def hard_negatives(rows: DataFrame, is_anchor: Column) -> tuple[DataFrame, DataFrame]:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; and how many scores each of the two
    passes reckoned (step, scored).

    rows has vec_id, label, embedding (numbers, whole after any scaling); is_anchor tells from vec_id which are
    anchors. Positives are the POSITIVES best other rows of an anchor's label, negatives of each the NEGATIVES best rows of
    other labels from LEAST percent of its score up to its score. Ties go to the smaller vec_id.

    Rows with a null id, label, vector or component, or one that is not finite, take no part. Missing components of
    shorter vectors count as 0. Repeated rows are rows of their own, except that an id is one anchor (with its
    smallest label and vector) and no row of that id is its positive. Scores beyond 64 bits are cut to them.
    Hot labels and equal vectors need no care: chunks and blocks are cut by number of rows alone.
    """
    rows = usable(rows)
    chunks = saved(packs(rows, CHUNK), "chunks", FILE)
    anchors = saved(_anchors(rows.where(is_anchor)), "anchors")
    anchors = anchors.repartitionByRange(max(1, -(-anchors.count() // BLOCK)), "label", "vec_id").sortWithinPartitions("label", "vec_id")
    blocks = saved(packs(anchors, BLOCK), "anchor-blocks", FILE)

    first = saved(_met(chunks, blocks, _positives, POSITIVES), "positives")
    positives = _ranked(first.drop("positive_id", "positive_score"), ["block", "anchor_id"], POSITIVES)
    window = F.struct("anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # At most POSITIVES windows for each of BLOCK anchors; a score below 0 has none.
    windows = positives.where("score >= 0").groupBy("block").agg(F.collect_list(window).alias("windows"))
    second = saved(_met(chunks, blocks.join(windows.hint("merge"), blocks["number"] == windows["block"]).drop("block"), _negatives, NEGATIVES), "negatives")
    result = _ranked(second, ["anchor_id", "positive_id"], NEGATIVES).select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )
    figures = [f.agg(F.lit(step).alias("step"), F.sum("scored").alias("scored")) for step, f in (("positives", first), ("negatives", second))]
    return result, figures[0].union(figures[1])
