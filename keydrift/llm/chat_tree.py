"""Chat formatting over a prefix tree (operator 8).

Conversations that begin with the same turns share them: every distinct beginning is one node of a tree, and
its tokens are emitted once, in one depth-first stream. A node carries its place in the stream, the position
ids of its tokens (they go on from its parent's) and the stream intervals of its ancestors, which with the
node itself are all that its tokens attend to.

Depth-first order is the order of the conversations sorted by their beginnings: the first conversation in that
order that has a node owns it, and what a conversation owns is the end of its path. So places are running sums
over sorted conversations. Nothing is gathered for a tree, only for one conversation at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keydrift.llm.common import kept_by_worker, mapped, saved

# The template's control strings, and who is trained on.
START, STOP, TRAINED = "<|im_start|>", "<|im_end|>", "assistant"


def escaped(text: Column) -> Column:
    """A text without control strings: `\\` becomes `\\\\` and `<|` becomes `<\\|`. `unescaped` takes it back."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\|\|)", "$1")


def escaped_role(role: Column) -> Column:
    """Roles stand on one line: a line feed in them becomes `\\l`."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\l"))


def _parts(turn: Column) -> Column:
    """Header, body and footer of a formatted turn, and whether its body is trained on."""
    return F.struct(
        F.concat(F.lit(START), escaped_role(turn["role"]), F.lit("\n")).alias("header"),
        escaped(turn["text"]).alias("body"),
        F.lit(f"{STOP}\n").alias("footer"),
        (turn["role"] == TRAINED).alias("trained"),
    )


def conversations_of(turns: DataFrame) -> DataFrame:
    """conv_id, turns (array of turn, role, text) in the order of turn; nulls as empty texts, a null turn first."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))


def tokenized(nodes: DataFrame, path: str) -> DataFrame:
    """node and its tokens: header, body and footer are encoded apart, so that the loss mask falls between tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = kept_by_worker(f"bytes {path}", lambda: _tokenizer(path))
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = [
                    [np.array(e.ids, np.int32) for e in tokens.encode_batch(part.column(c).to_pylist(), add_special_tokens=False)]
                    for c in ("header", "body", "footer")
                ]
                whole = [np.concatenate(x).tolist() for x in zip(*ids, strict=True)]
                begin = [len(h) for h in ids[0]]
                end = [len(h) + len(b) for h, b in zip(ids[0], ids[1], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), pa.array(whole, pa.list_(pa.int32())), pa.array(begin, pa.int64()), pa.array(end, pa.int64()), part.column("trained")],
                    names=["node", "ids", "body_begin", "body_end", "trained"],
                )

    return nodes.transform(mapped, run, "node string, ids array<int>, body_begin long, body_end long, trained boolean")


def _tokenizer(path: str) -> object:
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(path)
    tokens.encode_special_tokens = True
    return tokens


def tree(turns: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """The stream's nodes and every conversation's path through them.

    Nodes: node, offset (its place in the stream), position (of its first token in any conversation that has it),
    ids, loss_begin, loss_end (its trained tokens, counted from its first; null without), ancestors (array of
    stream intervals begin, end, from the root). Paths: conv_id, depth, node. path names a byte-level vocabulary.
    Rows that repeat a turn are turns of their own, in the order of role and text; a conversation that others
    continue shares all its nodes with them.
    """
    spoken = conversations_of(turns)
    step = lambda before, turn: F.concat(before, F.array(F.sha2(F.concat(F.element_at(before, -1), F.sha2(turn["role"], 256), turn["text"]), 256)))
    chain = F.slice(F.aggregate("turns", F.array(F.lit("")), step), 2, 1 << 30)
    told = saved(spoken.select("conv_id", F.transform("turns", _parts).alias("parts"), chain.alias("path")), "conversations")

    every = told.select("conv_id", F.posexplode(F.arrays_zip("path", "parts")).alias("depth", "x"))
    every = every.select("conv_id", "depth", F.col("x.path").alias("node"), "x.parts.*")
    one = every.groupBy("node").agg(*[F.first(c).alias(c) for c in ("header", "body", "footer", "trained")])
    tokens = saved(tokenized(one, path), "tokens")
    lengths = tokens.select("node", F.size("ids").cast("long").alias("tokens"))

    ranged = told.select("conv_id", "path").repartitionByRange("path", F.xxhash64("conv_id"), "conv_id")
    ranged = saved(ranged.withColumn("part", F.spark_partition_id()), "ranges")
    order = Window.partitionBy("part").orderBy("path", F.xxhash64("conv_id"), "conv_id")
    ranked = saved(ranged.withColumn("rank", F.row_number().over(order)), "ranked")
    paths = ranked.select("part", "rank", "conv_id", F.posexplode("path").alias("depth", "node"))
    owned = paths.groupBy("node").agg(F.min(F.struct("part", "rank")).alias("owner"), F.first("depth").alias("depth"))
    owned = saved(owned.join(lengths, "node").select("node", "depth", "tokens", "owner.part", "owner.rank"), "owned")
    sizes = owned.groupBy("part", "rank").agg(F.sum("tokens").alias("tokens"))
    parts = sizes.groupBy("part").agg(F.sum("tokens").alias("tokens"))  # a row for each range
    earlier = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", earlier.alias("part_at"))
    running = F.coalesce(F.sum("tokens").over(Window.partitionBy("part").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", "rank", running.alias("rank_at")).join(parts, "part")
    within = F.coalesce(
        F.sum("tokens").over(Window.partitionBy("part", "rank").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    placed = owned.withColumn("within", within).join(starts, ["part", "rank"])
    placed = saved(placed.select("node", "depth", "tokens", "part", "rank", (F.col("part_at") + F.col("rank_at") + F.col("within")).alias("offset")), "placed")

    # A node's ancestors are the beginning of its owner's path.
    owners = placed.select("part", "rank").distinct().withColumnsRenamed({"part": "p", "rank": "r"})
    own_paths = paths.join(owners, (paths.part == owners.p) & (paths["rank"] == owners.r)).select("part", "rank", "depth", "node")
    steps = own_paths.join(placed.select("node", "offset", "tokens"), "node")
    line = steps.groupBy("part", "rank").agg(F.sort_array(F.collect_list(F.struct("depth", "offset", "tokens"))).alias("line"))
    up = F.slice("line", F.lit(1), F.col("depth"))
    nodes = placed.join(line, ["part", "rank"]).select(
        "node", "offset",
        F.aggregate(up, F.lit(0).cast("long"), lambda s, x: s + x["tokens"]).alias("position"),
        F.transform(up, lambda x: F.struct(x["offset"].alias("begin"), (x["offset"] + x["tokens"]).alias("end"))).alias("ancestors"),
    )
    mask = [F.when(F.col("trained"), F.col(c)) for c in ("body_begin", "body_end")]
    nodes = nodes.join(tokens, "node").select("node", "offset", "position", "ids", mask[0].alias("loss_begin"), mask[1].alias("loss_end"), "ancestors")
    return saved(nodes, "nodes"), paths.select("conv_id", "depth", "node")


def texts(nodes: DataFrame, path: str) -> DataFrame:
    """Nodes with the text that their ids decode to, and that of their trained tokens (null without)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = kept_by_worker(f"bytes {path}", lambda: _tokenizer(path))
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids, begin, end = (part.column(c).to_pylist() for c in ("ids", "loss_begin", "loss_end"))
                whole = tokens.decode_batch(ids, skip_special_tokens=False)
                masked = [x[b:e] if b is not None else [] for x, b, e in zip(ids, begin, end, strict=True)]
                loss = [t if b is not None else None for t, b in zip(tokens.decode_batch(masked, skip_special_tokens=False), begin, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), part.column("offset"), pa.array(whole, pa.string()), pa.array(loss, pa.string())], names=["node", "offset", "text", "loss"]
                )

    return nodes.select("node", "offset", "ids", "loss_begin", "loss_end").transform(mapped, run, "node string, offset long, text string, loss string")


def read_back(nodes: DataFrame, paths: DataFrame, path: str) -> DataFrame:
    """conv_id, formatted (the conversation's whole text), turns (role, text) and loss (trained texts in order)."""
    rows = paths.join(texts(nodes, path), "node")
    told = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "text", "loss"))).alias("line"))
    told = told.select(
        "conv_id",
        F.array_join(F.transform("line", lambda x: x["text"]), "").alias("formatted"),
        F.array_join(F.transform("line", lambda x: unescaped(F.coalesce(x["loss"], F.lit("")))), "").alias("loss"),
    )
    turn = rf"(?s){_quoted(START)}([^\n]*)\n(.*?){_quoted(STOP)}\n"
    roles, bodies = (F.regexp_extract_all("formatted", F.lit(turn), F.lit(k)) for k in (1, 2))
    role = lambda x: unescaped(F.regexp_replace(x, r"(?<!\\)((?:\\\\)*)\\l", "$1\n"))
    both = F.zip_with(roles, bodies, lambda r, b: F.struct(role(r).alias("role"), unescaped(b).alias("text")))
    return told.select("conv_id", "formatted", both.alias("turns"), "loss")


def _quoted(control: str) -> str:
    return control.replace("|", r"\|")
