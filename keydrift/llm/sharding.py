"""Shards on a consistent-hash ring with virtual nodes and bounded loads (operator 6).

A key belongs to the next virtual node clockwise of its hash. A shard takes as many keys as its bound; keys
that find it full go on clockwise. The bounds add up to the number of keys and differ by one at most, so all
shards end full: their counts are at most one apart (law `rows`).

Which keys overflow follows from the counts per arc alone, arcs being as many as virtual nodes: a table whose size
the number of shards sets. The keys of an arc are ranked in the order of their hashes, in small cells that are ranked
apart; equal rows, of which there may be any number, are counted off in several salts.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keydrift.llm.common import saved

#: Virtual nodes of a shard, cells of an arc in which keys are ranked, and salts of equal rows.
VIRTUAL, CELLS, SALTS = 64, 32, 64
#: Positions on the ring are whole numbers of so many bits.
BITS = 63


def position(*columns):
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - BITS)


def ring(spark: SparkSession, shards: int, virtual: int = VIRTUAL) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, clockwise; an arc is named by its node's place in this list."""
    copies = F.explode(F.sequence(F.lit(0), F.lit(virtual - 1))).alias("copy")
    nodes = spark.range(shards).select(F.col("id").alias("shard"), copies)
    return sorted((r.at, r.shard) for r in nodes.select(position("shard", "copy").alias("at"), "shard").collect())


def sectors(spark: SparkSession, nodes: list[tuple[int, int]]) -> tuple[DataFrame, int]:
    """The ring cut into equal sectors, four or more for each node: sector, first_arc (of the first node in or after
    it), inside (positions of the nodes in it); and by how many bits a position is shifted to give its sector."""
    shift = BITS - max(10, (4 * len(nodes)).bit_length())
    at = [p for p, _ in nodes]
    edges = [bisect_left(at, sector << shift) for sector in range((1 << BITS - shift) + 1)]
    rows = [(sector, begin, at[begin:end]) for sector, (begin, end) in enumerate(zip(edges, edges[1:]))]
    return spark.createDataFrame(rows, "sector long, first_arc long, inside array<long>"), shift


def overflow(arcs: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot) for arcs (arc, shard, keys) in ring order.

    Round by round every arc's waiting keys ask the next node clockwise, in ring order within a round.
    """
    total = sum(n for _, _, n in arcs)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    taken = [0] * shards
    waiting = [(i, 0, n) for i, (_, _, n) in enumerate(arcs) if n]
    out, hop = [], 0
    while waiting:
        still = []
        for i, begin, end in waiting:
            shard = arcs[(i + hop) % len(arcs)][1]
            stop = min(end, begin + room[shard])
            if stop > begin:
                out.append((arcs[i][0], begin, stop, shard, taken[shard]))
                room[shard] -= stop - begin
                taken[shard] += stop - begin
            if stop < end:
                still.append((i, stop, end))
        waiting, hop = still, hop + 1
    return out


def sharded(docs: DataFrame, shards: int = 24, virtual: int = VIRTUAL) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless from 0 in a shard), grown_shard (null) for every row.

    size is the text's UTF-8 bytes plus 8, with 0 bytes for null; its checksum is then that of no bytes. The key
    is doc_id; rows without one are keyed by their text's checksum. Repeated rows are placed one by one.
    Other columns are not read. Only counts per arc and cell come to the driver, as many as the shards' nodes times CELLS.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    key = position(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("text_crc32"))))
    nodes = ring(spark, shards, virtual)
    parts, shift = sectors(spark, nodes)
    rows = rows.withColumn("at", key).withColumns(
        {
            "sector": F.shiftright("at", shift),
            "cell": F.pmod(F.xxhash64("at", "text_crc32"), F.lit(CELLS)),
            "salt": F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)),
        }
    )
    passed = F.size(F.filter("inside", lambda node: node < F.col("at")))
    rows = rows.join(F.broadcast(parts), "sector").withColumn("arc", (F.col("first_arc") + passed) % len(nodes))
    # Written, since a salt follows from where a row was read and must not change when a task runs again.
    rows = saved(rows.drop("sector", "first_arc", "inside"), "shards")
    counts = rows.groupBy("arc", "cell").agg(F.count(F.lit(1)).alias("keys"))
    known = {(r.arc, r.cell): r["keys"] for r in counts.collect()}
    arcs = [(arc, shard, sum(known.get((arc, c), 0) for c in range(CELLS))) for arc, (_, shard) in enumerate(nodes)]
    before, starts = {}, []
    for (arc, cell), n in sorted(known.items()):
        starts.append((arc, cell, before.get(arc, 0)))
        before[arc] = before.get(arc, 0) + n
    cells = spark.createDataFrame(starts, "arc long, cell long, earlier long")
    taken = spark.createDataFrame(overflow(arcs, shards), "arc long, first long, end long, shard int, slots long")
    equal = ["arc", "cell", "at", "text_crc32", "size", "salt"]
    inside = Window.partitionBy("arc", "cell").orderBy("at", "text_crc32", "size", "salt")
    lots = rows.groupBy(*equal).agg(F.count(F.lit(1)).alias("n"))
    lots = lots.withColumn("ahead", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    ranked = rows.withColumn("turn", F.row_number().over(Window.partitionBy(*equal).orderBy("doc_id")) - 1)
    ranked = ranked.join(lots.drop("n"), equal).join(F.broadcast(cells), ["arc", "cell"])
    ranked = ranked.withColumn("rank", F.col("turn") + F.col("ahead") + F.col("earlier"))
    placed = ranked.join(F.broadcast(taken), ["arc"]).where("rank >= first and rank < end")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("slots") + F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
