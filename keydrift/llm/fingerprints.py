"""Document fingerprints as a homomorphic multiset hash (operator 7).

A paragraph is hashed to a wide vector; a document's fingerprint is the sum of its paragraphs' vectors modulo
2**32 in every lane. So it does not depend on the order of paragraphs, and a paragraph is inserted or deleted
by adding or subtracting its vector. Eight lanes are the paragraph's SHA-256 and decide equality; the other
lanes count, over the paragraph's three-word runs, the ones in each bit of their hashes, which keeps
the sum's direction alike for documents with paragraphs or passages in common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keydrift.llm.common import saved

#: Lanes of 32 bits from a paragraph's SHA-256; bits of a run's hash that are counted.
WIDE, BITS = 8, 64
LANES = WIDE + BITS + 1
MODULUS = 1 << 32
GAP = "[\\x20\\x09-\\x0D]+"


def lanes(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and `lanes`: the vector of each row's text. keys tell rows apart; empty texts have the zero vector.

    A blank paragraph of a text that is not empty counts in the wide lanes like any other, but has no words.
    """
    parts = rows.select(*keys, (F.col(text) != "").alias("given"), F.explode(F.split(F.col(text), "\n")).alias("paragraph"))
    words = parts.select(*keys, "given", "paragraph", F.split("paragraph", GAP).alias("words"), F.sha2(F.col("paragraph").cast("binary"), 256).alias("digest"))
    runs = words.select(*keys, "given", "paragraph", "words", "digest", F.posexplode("words").alias("at", "word"))
    run = F.xxhash64("word", F.get("words", F.col("at") + 1), F.get("words", F.col("at") + 2))
    wide = [F.conv(F.substring("digest", 8 * i + 1, 8), 16, 10).cast("long") for i in range(WIDE)]
    first = F.col("given") & (F.col("at") == 0)
    hashed = runs.select(*keys, (F.col("paragraph") != "").alias("some"), run.alias("run"), *[F.when(first, x).otherwise(0).alias(f"wide{i}") for i, x in enumerate(wide)])
    low = F.lit(MODULUS - 1)
    pair = F.lit((1 << 32) | 1)
    when = lambda value: F.when(F.col("some"), value).otherwise(0)
    sums = [F.sum(f"wide{i}").alias(f"w{i}") for i in range(WIDE)]
    # Bits k and k + 32 of every run are counted in the halves of one sum, which no text is long enough to overflow.
    sums += [F.sum(when(F.shiftrightunsigned("run", k).bitwiseAND(pair))).alias(f"b{k}") for k in range(BITS // 2)]
    sums += [F.sum(when(F.lit(1))).alias("n")]
    summed = hashed.groupBy(*keys).agg(*sums)
    out = [F.col(f"w{i}") for i in range(WIDE)]
    out += [F.col(f"b{k}").bitwiseAND(low) for k in range(BITS // 2)] + [F.shiftrightunsigned(f"b{k}", 32) for k in range(BITS // 2)]
    vector = F.transform(F.array(*[x.cast("long") for x in [*out, F.col("n").cast("long")]]), lambda x: F.pmod(x, F.lit(MODULUS)))
    return summed.select(*keys, vector.alias("lanes"))


def combined(left: Column, right: Column, sign: int = 1) -> Column:
    """The vector of both documents together, or of left without right (sign -1)."""
    return F.zip_with(left, right, lambda a, b: F.pmod(a + sign * b, F.lit(MODULUS)))


def fingerprint(vector: Column) -> Column:
    """The vector as hexadecimal digits, eight a lane."""
    return F.array_join(F.transform(vector, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(left: Column, right: Column) -> Column:
    """0 to 1: 1 for equal vectors, else the cosine of the counted directions; 0 against an empty text."""
    def direction(v: Column) -> Column:
        n = F.element_at(v, LANES)
        return F.transform(F.slice(v, WIDE + 1, BITS), lambda x: (2 * x - n).cast("double"))

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    a, b = direction(left), direction(right)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    cosine = F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)
    return F.when(left == right, 1.0).otherwise(F.least(F.greatest(cosine, F.lit(0.0)), F.lit(1.0)))


def succession(ids: DataFrame) -> DataFrame:
    """doc_id, next_id for distinct doc_ids (null first): the next one in ascending order, after the last the first.

    Ids are dealt out by ranges; only the first id of each range is looked at in one task.
    """
    ranged = ids.select("doc_id").distinct().repartitionByRange("doc_id")
    ranged = saved(ranged.withColumn("part", F.spark_partition_id()), "ranges")
    here = Window.partitionBy("part").orderBy("doc_id")
    within = ranged.withColumn("next", F.lead(F.struct("doc_id")).over(here))
    firsts = ranged.groupBy("part").agg(F.min(F.struct("doc_id")).alias("first"))
    every = Window.orderBy("part")
    after = F.coalesce(F.lead("first").over(every), F.first("first").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    following = firsts.select("part", after.alias("after"))
    joined = within.join(following, "part").withColumn("next", F.coalesce("next", "after"))
    return joined.select("doc_id", F.col("next.doc_id").alias("next_id"))


def with_edits(docs: DataFrame) -> DataFrame:
    """doc_id, row, text, next_id, n_chars, edited: the last half of each text replaced by the next one's beginning.

    Of rows that repeat a doc_id all are edited alike, and the next document of any is the next larger doc_id;
    where that is repeated, its smallest text stands for it.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sizes = saved(base.groupBy("doc_id").agg(F.max(F.length("text")).alias("most"), F.count(F.lit(1)).alias("rows")), "sizes")
    order = saved(succession(sizes).join(sizes.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id"))).drop("id"), "order")
    wanted = order.select(F.col("doc_id").alias("target"), F.col("next_id"), F.floor(F.col("most") / 2).cast("int").alias("need"))
    heads = base.join(wanted, base.doc_id.eqNullSafe(wanted.next_id)).select("target", F.substring("text", F.lit(1), F.col("need")).alias("head"), "next_id")
    if not sizes.where("rows > 1").isEmpty():
        heads = heads.groupBy("target", "next_id").agg(F.min("head").alias("head"))
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("head", F.lit(1), half))
    rows = base.join(heads, base.doc_id.eqNullSafe(heads.target))
    return rows.select("doc_id", F.monotonically_increasing_id().alias("row"), "text", "next_id", n.cast("long").alias("n_chars"), edited.alias("edited"))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts count as empty. A table of one row is its own next document. Columns but doc_id and text are
    not read.
    """
    rows = with_edits(docs).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body")))
    keys = ["doc_id", "row", "next_id", "n_chars", "edited_sha256"]
    each = rows.select(*keys, F.inline(kinds))
    vectors = lanes(each, [*keys, "kind"], "body")
    pairs = vectors.groupBy(*keys).agg(
        F.max(F.when(F.col("kind") == 0, F.col("lanes"))).alias("own"), F.max(F.when(F.col("kind") == 1, F.col("lanes"))).alias("edit")
    )
    pairs = saved(pairs, "vectors")
    after = pairs.select(F.col("doc_id").alias("id"), F.col("own").alias("next_own"))
    if not pairs.groupBy("doc_id").count().where("count > 1").isEmpty():
        after = after.groupBy("id").agg(F.min("next_own").alias("next_own"))
    both = pairs.join(after, pairs.next_id.eqNullSafe(after.id))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("edit")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("edit")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
