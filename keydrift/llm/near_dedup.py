"""Near-duplicates by an LSH forest of MinHash signatures (operator 2).

Each text is the set of its 5-word shingles. Texts with equal sets are one class, named by its smallest
doc_id. Every class stands in several sorted orders; an order sorts by its own run of signature positions, so
classes with a long common prefix are neighbours. Neighbours of a class are candidates if they share a prefix:
in a sparse region one position is enough, in a dense region the nearest rows are those that agree to a
greater depth. Candidates are confirmed on full sets, and the links' components are the groups.

An order is dealt out by ranges of its sort key with a tie-breaker, so that a group of any size spreads over
tasks and yields at most REACH candidates per row; nothing is emitted for all pairs of a group.

Where more rows than that share two positions, the neighbours are not all pairs. Such regions, unless they lie
within one component already, are compared whole: in pairs of salted blocks of bounded size, first by signature,
then, the rows that are near some row of another component, by full sets. A task returns at most one link per
component that it saw, so components grow together and still nothing is emitted for all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keydrift.llm.common import components, if_small, mapped, mixed, numbers, saved, slices, utf8

WORDS = 5
#: Linked if 100 * intersection >= 75 * union.
PERCENT = 75
HASHES, ORDERS, DEPTH = 64, 12, 16
#: A row's candidates in an order: so many rows before it; one where whole prefixes are equal.
REACH = 4
#: Positions of an order's DEPTH that a candidate has in common. At similarity 0.75 fewer agree in 0.7 % of the
#: orders in which the pair meets, independently enough that all orders together miss practically none.
AGREE = 8
#: Where the pairs of positions begin that name regions, the first of each two where an order begins: one of 24 agrees
#: but in 2e-9 of the pairs at 0.75.
REGIONS = [k * HASHES // ORDERS + o for k in range(ORDERS) for o in (0, 2)]
#: Positions of the whole signature that agree where sets are compared: fewer do in 5e-6 of the pairs at 0.75.
ALIKE = 32
#: Rows and shingles of a block.
BLOCK_ROWS, BLOCK_SHINGLES = 2_048, 1_000_000
#: In a pair of blocks, rows of a shingle from which on it is counted by matrix products.
FREQUENT = 32
GAP = np.zeros(256, bool)
GAP[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE = numbers(256, 11)
STEP = np.uint64(0x5851F42D4C957F2D)
BACK = np.uint64(pow(int(STEP), -1, 1 << 64))
SCALE = numbers(HASHES, 29) | np.uint64(1)
SHIFT = numbers(HASHES, 31)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """For each text its distinct shingles as sorted 64-bit hashes: words between white space, A-Z lower-cased."""
    data, at = utf8(texts)
    gap = GAP[data]
    begins = np.concatenate([[True], gap])[: len(data)]
    begins[at[:-1][at[:-1] < len(data)]] = True
    starts = np.flatnonzero(begins & ~gap)
    # A word ends at the next gap or with its text.
    stops = np.concatenate([np.flatnonzero(gap), at[1:]])
    stops.sort()
    ends = stops[np.searchsorted(stops, starts, side="right")] if len(starts) else starts
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[LOWER[data]] * _powers(STEP, len(data))[:-1], dtype=np.uint64, out=sums[1:])
    words = mixed((sums[ends] - sums[starts]) * _powers(BACK, len(data))[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, at)
    rolled = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        rolled = mixed(rolled + words[k : len(words) - WORDS + 1 + k] * np.uint64(2 * k + 1)) if len(rolled) else rolled
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= WORDS:
            out.append(np.unique(rolled[a : b - WORDS + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for w in range(a, b):
                whole = mixed(whole * np.uint64(3) + words[w : w + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash signatures of sets that are not empty: one row of HASHES 32-bit minima each."""
    at = np.cumsum([0, *map(len, sets)])[:-1]
    every = np.concatenate(sets)
    out = np.empty((len(sets), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(((every * SCALE[k] + SHIFT[k]) >> np.uint64(32)).astype(np.uint32), at)
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            sets = shingle_sets(part.column("text"))
            full = [i for i, s in enumerate(sets) if len(s)]
            signatures = iter(_signatures([sets[i] for i in full]) if full else ())
            keys, signs = [], []
            for s in sets:
                both = np.array([mixed(s).sum(), mixed(s ^ STEP).sum()], np.uint64)
                keys.append(both.tobytes() if len(s) else None)
                signs.append(next(signatures).astype(">u4").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(signs, pa.binary())],
                names=["doc_id", "n_shingles", "class_key", "signature"],
            )


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_key (equal for equal sets; null without words), signature."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(
        mapped,
        _sign, "doc_id long, n_shingles long, class_key binary, signature binary"
    )


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    turn = [4 * ((np.arange(DEPTH) + k * HASHES // ORDERS) % HASHES) for k in range(ORDERS)]
    places = np.array([[p + b for p in t for b in range(4)] for t in turn])
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        signs = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(n, 4 * HASHES)
        paths = signs[:, places].transpose(1, 0, 2).tobytes()
        width = 4 * DEPTH
        node, size = batch.column("node").to_numpy(), batch.column("n_shingles").to_numpy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(ORDERS, dtype=np.int32), n)),
             pa.array([paths[i : i + width] for i in range(0, len(paths), width)], pa.binary()),
             pa.array(np.tile(node, ORDERS)), pa.array(np.tile(size, ORDERS))],
            names=["tree", "path", "node", "n_shingles"],
        )


def _pairs(trees: np.ndarray, paths: np.ndarray, nodes: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Candidates among consecutive rows of the sorted orders."""
    found = []
    for lag in range(1, min(REACH, len(nodes) - 1) + 1):
        same = paths[lag:] == paths[:-lag]
        agree = same.sum(axis=1)
        near = (trees[lag:] == trees[:-lag]) & same[:, 0] & (agree >= AGREE) & (nodes[lag:] != nodes[:-lag])
        low, high = np.minimum(sizes[lag:], sizes[:-lag]), np.maximum(sizes[lag:], sizes[:-lag])
        near &= 100 * low >= PERCENT * high
        if lag > 1:
            near &= agree < DEPTH
        at = np.flatnonzero(near)
        found.append(np.stack([nodes[at], nodes[at + lag]]))
    return found


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of near rows in a sorted partition; its first and last REACH rows are passed on as edges."""
    tail, begun = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(c) for c in ("tree", "path", "node", "n_shingles")]
        if not begun:
            yield _edges([c[:REACH] for c in rows])
            begun = True
        if tail:
            rows = [pa.concat_arrays([t, c]) for t, c in zip(tail, rows, strict=True)]
        trees, nodes, sizes = rows[0].to_numpy(), rows[2].to_numpy(), rows[3].to_numpy()
        paths = np.frombuffer(b"".join(rows[1].to_pylist()), ">u4").reshape(len(nodes), DEPTH)
        a, b = np.concatenate(_pairs(trees, paths, nodes, sizes) or [np.zeros((2, 0), np.int64)], axis=1)
        none = pa.nulls(len(a), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), none, pa.nulls(len(a), pa.binary()),
             pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int64())],
            names=["a", "b", "tree", "path", "node", "n_shingles"],
        )
        tail = [c[-REACH:] for c in rows]
    if tail:
        yield _edges(tail)


def _edges(rows: list[pa.Array]) -> pa.RecordBatch:
    none = pa.nulls(len(rows[0]), pa.int64())
    return pa.RecordBatch.from_arrays([none, none, *rows], names=["a", "b", "tree", "path", "node", "n_shingles"])


PAIRS = "a long, b long, tree int, path binary, node long, n_shingles long"


def candidates(classes: DataFrame) -> DataFrame:
    """Distinct pairs a < b of classes (node, n_shingles, signature) that are neighbours in some order."""
    rows = classes.transform(mapped, _prefixes, "tree int, path binary, node long, n_shingles long")
    key = ["tree", "path", F.xxhash64("node", "tree"), "node"]
    walked = saved(rows.repartitionByRange(*key).sortWithinPartitions(*key).transform(mapped, _neighbours, PAIRS), "walked")
    # Rows beside the borders of partitions, 2 * REACH of each: walked once more in one sorted partition.
    borders = walked.where("node is not null").drop("a", "b").distinct().coalesce(1).sortWithinPartitions(*key)
    across = borders.transform(mapped, _neighbours, PAIRS)
    return walked.union(across).where("a is not null").select("a", "b").distinct()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            sets = [s.tobytes() for s in shingle_sets(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * common >= PERCENT * (len(x) + len(y) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def links(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose full sets of shingles are similar enough. A class's set is that of one of its texts."""
    nodes = saved(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b"))).distinct(), "nodes")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    sets = texts.join(if_small(nodes), "node", "left_semi").transform(mapped, _sets, "node long, shingles binary")
    # Rows that repeat a doc_id are one document: its largest set stands for it.
    sets = saved(sets, "sets").groupBy("node").agg(F.max("shingles").alias("shingles"))
    both = (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    )
    return both.select("a", "b", "x", "y").transform(mapped, _confirm, "a long, b long")


def _blocked(rows: DataFrame) -> DataFrame:
    """Rows of regions (region, node, n_shingles) with i, j: every two rows of a region meet in some (region, i, j)."""
    sums = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_ROWS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    sums = saved(sums.where("n > 1").select("region", blocks.alias("blocks")), "blocks")
    own = F.pmod(F.xxhash64("node", "region"), F.col("blocks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: (F.col("blocks") == 1) | (b != F.col("own")))
    dealt = rows.join(if_small(sums), "region").withColumn("own", own).withColumn("other", F.explode(others))
    return dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("own", "other", "blocks")


def _open(group: pa.Table) -> pa.Table:
    """The rows whose signature is like that of a row of another component."""
    n = group.num_rows
    signs = np.frombuffer(b"".join(group.column("signature").to_pylist()), ">u4").reshape(n, HASHES).T.astype(np.uint32)
    component, size = group.column("component").to_numpy(), group.column("n_shingles").to_numpy()
    found = np.zeros(n, bool)
    for begin in range(0, n, 256):
        part = slice(begin, begin + 256)
        agree = np.zeros((len(component[part]), n), np.uint8)
        for sign in signs:
            agree += sign[part, None] == sign[None]
        near = (agree >= ALIKE) & (component[part, None] != component[None])
        near &= (100 * size[part, None] >= PERCENT * size[None]) & (100 * size[None] >= PERCENT * size[part, None])
        found[part] |= near.any(axis=1)
    return group.select(["region", "node"]).filter(pa.array(found))


def common(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles every two sets have in common."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    order = np.argsort(every, kind="stable")
    row, every = row[order], every[order]
    starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
    held = np.diff(np.append(starts, len(every)))
    number = np.repeat(np.arange(len(starts)), held)
    many = np.flatnonzero(held >= FREQUENT)
    out = np.zeros((n, n), np.float32)  # whole numbers below 2**24 are exact
    column = np.full(len(starts), -1)
    column[many] = np.arange(len(many))
    for begin in range(0, len(many), 1_024):
        mine = (column[number] >= begin) & (column[number] < begin + 1_024)
        member = np.zeros((n, min(1_024, len(many) - begin)), np.float32)
        member[row[mine], column[number[mine]] - begin] = 1
        out += member @ member.T
    few = held[number] < FREQUENT
    row, number = row[few], number[few]
    for lag in range(1, FREQUENT):
        at = np.flatnonzero(number[lag:] == number[:-lag]) if lag < len(number) else np.zeros(0, np.int64)
        np.add.at(out, (row[at], row[at + lag]), 1)  # rows ascend within a shingle
        np.add.at(out, (row[at + lag], row[at]), 1)
    return out


def _joined(group: pa.Table) -> pa.Table:
    """Links (a, b) of components with similar sets, so many that the group's components hang together."""
    sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
    own = group.column("component").to_numpy()
    size, label, shared = np.array([len(s) for s in sets]), own.copy(), common(sets)
    a, b = [], []
    for i in range(len(sets)):
        near = 100 * shared[i].astype(np.int64) >= PERCENT * (size[i] + size - shared[i].astype(np.int64))
        at = np.flatnonzero(near & (label != label[i]))
        _, first = np.unique(label[at], return_index=True)
        a += [own[i]] * len(first)
        b += own[at[first]].tolist()
        label[np.isin(label, label[at])] = label[i]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def dense_links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) of components that lack one, for classes (node, component, n_shingles, signature) in dense regions."""
    heads = F.posexplode(F.array(*[F.substring("signature", 4 * p + 1, 8) for p in REGIONS])).alias("k", "head")
    heads = classes.select("node", "component", "n_shingles", heads)
    heads = heads.select("node", "component", "n_shingles", F.xxhash64("k", "head").alias("region"))
    # Up to REACH + 1 rows that share an order's beginning have all met as neighbours. A pair at 0.75 shares none of
    # the 12 beginnings in 5e-5 of the cases.
    regions = heads.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    regions = saved(regions.where(F.col("n") > REACH + 1).where("low <> high").select("region"), "regions")
    members = saved(heads.join(if_small(regions), "region", "left_semi").select("region", "node", "n_shingles"), "members")
    known = classes.select("node", "component", "signature")
    signs = _blocked(members).join(known, "node").select("region", "i", "j", "node", "component", "n_shingles", "signature")
    opened = signs.groupBy("region", "i", "j").applyInArrow(_open, "region long, node long")
    opened = saved(opened.distinct(), "opened")
    nodes = saved(opened.select("node").distinct(), "open-nodes")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(if_small(nodes), "node", "left_semi")
    sets = saved(texts.transform(mapped, _sets, "node long, shingles binary"), "open-sets")
    sets = sets.groupBy("node").agg(F.max("shingles").alias("shingles"))
    rows = _blocked(opened.join(classes.select("node", "component", "n_shingles"), "node"))
    rows = rows.join(sets, "node").select("region", "i", "j", "component", "shingles")
    return rows.groupBy("region", "i", "j").applyInArrow(_joined, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of doc_id and text.

    component_id is the smallest doc_id reachable over links, kept is doc_id = component_id. Null and empty
    texts have no shingles and are linked with nothing. doc_id names a document: rows that repeat it count as
    one and are all kept if it is. A row without doc_id is linked with nothing, its component_id is null and it
    is kept. Other columns are not read.
    """
    rows = saved(signed(docs), "signatures")
    named = rows.where("class_key is not null and doc_id is not null")
    classes = saved(
        named.groupBy("class_key").agg(
            F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")
        ),
        "classes",
    )
    found = saved(links(docs, saved(candidates(classes.drop("class_key")), "pairs")), "links")
    groups = classes.join(if_small(saved(components(found), "components")), "node", "left")
    groups = saved(groups.withColumn("component", F.coalesce("component", "node")), "groups")
    more = saved(dense_links(docs, groups.drop("class_key")), "dense-links")
    groups = groups.select("class_key", "component")
    if not more.isEmpty():
        wider = saved(components(more).select(F.col("node").alias("component"), F.col("component").alias("wider")), "wider")
        groups = groups.join(if_small(wider), "component", "left").withColumn("component", F.coalesce("wider", "component"))
    groups = groups.select("class_key", F.col("component").alias("component_id"))
    with_group = rows.drop("signature").join(groups, "class_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return with_group.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    )
