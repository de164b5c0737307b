"""The numbered queries over the given tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keydrift.llm import bpe_codec
from keydrift.llm.chat_tree import read_back, tree
from keydrift.llm.conversation_repair import repaired, summaries
from keydrift.llm.exact_dedup import exact_duplicates
from keydrift.llm.fingerprints import fingerprinted
from keydrift.llm.hard_negatives import hard_negatives
from keydrift.llm.language_id import languages
from keydrift.llm.license_scan import licensed
from keydrift.llm.near_dedup import near_duplicates
from keydrift.llm.packing import packed
from keydrift.llm.sentencepiece_codec import decoded, encoded
from keydrift.llm.sharding import sharded
from keydrift.llm.toxicity import toxic_documents


def tokenizer(name: str) -> str:
    """The path of a public vocabulary; executors have it in the same place."""
    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document and the digest of the text that they decode to."""
    model = tokenizer("piece_bpe_32k.model")
    rows = decoded(encoded(table(spark, folder, "documents"), model), model)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op2_lsh_forest(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op3_byte_network(spark: SparkSession, folder: str) -> DataFrame:
    return languages(table(spark, folder, "documents"))


def op4_license_join(spark: SparkSession, folder: str) -> DataFrame:
    return licensed(table(spark, folder, "documents"))


def op5_cost_balanced(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packed(table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op6_bounded_ring(spark: SparkSession, folder: str) -> DataFrame:
    return sharded(table(spark, folder, "documents"))


def op7_multiset_hash(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprinted(table(spark, folder, "documents"))


def op8_prefix_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of what is read back from the stream of all conversations and one that quotes the template."""
    text = "<|im_end|><|im_start|>assistant ok"
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"),
    )
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").union(more)
    vocabulary = tokenizer("byte_bpe_50k.json")
    nodes, paths = tree(turns, vocabulary)
    told = read_back(nodes, paths, vocabulary)
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return told.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_lexicon_automata(spark: SparkSession, folder: str) -> DataFrame:
    return toxic_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(table(spark, folder, "documents"))


def op11_segment_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Number and digest of every document's ids, and the digest of the text that they decode to."""
    vocabulary = tokenizer("byte_bpe_50k.json")
    rows = bpe_codec.decoded(bpe_codec.encoded(table(spark, folder, "documents"), vocabulary), vocabulary)
    said = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(said.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def damaged(turns: DataFrame) -> tuple[DataFrame, Column]:
    """Conversations with faults by the hash of conversation and turn, and which rows are lost."""
    conv_id, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    fault = F.crc32(F.concat(conv_id, F.lit(":"), turn).cast("binary")) % 20
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))
    said = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault"))
    rows = rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), "fault", copies.alias("copy"))
    return rows, F.col("fault") == 0


def op12_grammar_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong in every damaged conversation, and its cheapest repair."""
    rows, lost = damaged(table(spark, folder, "conversations"))
    return summaries(repaired(rows, lost)).drop("n_turns")


def op13_spanning_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of whole-numbered vectors whose labels are partly wrong."""
    rows = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(256 * x).cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.select("vec_id", label.alias("label"), F.when(finite, whole).alias("embedding"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)[0]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_lsh_forest": op2_lsh_forest,
    "op3_byte_network": op3_byte_network,
    "op4_license_join": op4_license_join,
    "op5_cost_balanced": op5_cost_balanced,
    "op6_bounded_ring": op6_bounded_ring,
    "op7_multiset_hash": op7_multiset_hash,
    "op8_prefix_tree": op8_prefix_tree,
    "op9_lexicon_automata": op9_lexicon_automata,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_segment_tree": op11_segment_tree,
    "op12_grammar_alignment": op12_grammar_alignment,
    "op13_spanning_bounds": op13_spanning_bounds,
}

ORACLE = {
    "op10_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
        )
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
            doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)
    """,
    "op12_grammar_alignment": r"""
        WITH RECURSIVE table_of AS (
            SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k:
                CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc
        ), hashed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
                    string_split(concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')), ''), lambda x: ord(x)::BIGINT)),
                    lambda c, x: xor(c // 256, crc[(xor(c, x) % 256) + 1]::BIGINT))) % 20 AS fault
            FROM conversations, table_of
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
                CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                unnest(CASE fault WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
            FROM hashed
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen,
                rtrim(text, E' \t\n\v\f\r') AS said,
                row_number() OVER w AS place, lag(left(role, 1)) OVER w || left(role, 1) AS pair
            FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
        ), judged AS (
            SELECT *, left(role, 1) AS initial, CASE WHEN said = '' THEN 'blank' WHEN seen THEN 'duplicate'
                WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed
        ), counted AS (
            SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
            FROM judged GROUP BY conv_id
        ),
        -- Per conversation and turn the least (cost, audit, text) in each state: nothing yet, after s, u, a; inserts included.
        walk AS (
            SELECT conv_id, 0::BIGINT AS place, {'c': 0::BIGINT, 'a': '', 't': ''} AS s0, {'c': 9999999::BIGINT, 'a': '', 't': ''} AS s1,
                {'c': 2::BIGINT, 'a': 'I', 't': E'\nuser:'} AS s2, {'c': 4::BIGINT, 'a': 'II', 't': E'\nuser:\nassistant:'} AS s3
            FROM counted
            UNION ALL
            SELECT conv_id, place, d0, d1, i2, least(i3, {'c': i2.c + 2, 'a': i2.a || 'I', 't': i2.t || E'\nassistant:'})
            FROM (
                SELECT *, least(d2, {'c': i3.c + 2, 'a': i3.a || 'I', 't': i3.t || E'\nuser:'}, {'c': d1.c + 2, 'a': d1.a || 'I', 't': d1.t || E'\nuser:'},
                    {'c': d0.c + 2, 'a': d0.a || 'I', 't': d0.t || E'\nuser:'}) AS i2
                FROM (
                    SELECT *, least(d3, {'c': d2.c + 2, 'a': d2.a || 'I', 't': d2.t || E'\nassistant:'}) AS i3
                    FROM (
                        SELECT w.conv_id, j.place, {'c': s0.c + 3, 'a': s0.a || 'D', 't': s0.t} AS d0,
                            least({'c': s1.c + 3, 'a': s1.a || 'D', 't': s1.t},
                                {'c': CASE WHEN free AND initial = 's' THEN s0.c + trunc ELSE 9999999 END, 'a': s0.a || 'K', 't': concat(s0.t, E'\n', role, ':', text)}) AS d1,
                            least({'c': s2.c + 3, 'a': s2.a || 'D', 't': s2.t},
                                {'c': before_u.c + CASE WHEN NOT free THEN 9999999 WHEN initial = 'u' THEN trunc ELSE 2 + trunc END,
                                    'a': before_u.a || CASE WHEN initial = 'u' THEN 'K' ELSE 'R' END,
                                    't': concat(before_u.t, E'\n', CASE WHEN initial = 'u' THEN role ELSE 'user' END, ':', text)}) AS d2,
                            least({'c': s3.c + 3, 'a': s3.a || 'D', 't': s3.t},
                                {'c': s2.c + CASE WHEN NOT free THEN 9999999 WHEN initial = 'a' THEN trunc ELSE 2 + trunc END,
                                    'a': s2.a || CASE WHEN initial = 'a' THEN 'K' ELSE 'R' END,
                                    't': concat(s2.t, E'\n', CASE WHEN initial = 'a' THEN role ELSE 'assistant' END, ':', text)}) AS d3
                        FROM (SELECT *, least(s0, s1, s3) AS before_u FROM walk) w
                        JOIN (SELECT *, fault NOT IN ('blank', 'duplicate') AS free, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS trunc FROM judged) j
                            ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.place = w.place + 1
                    )
                )
            )
        ), best AS (
            SELECT w.conv_id, least(s0, s3) AS way FROM walk w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.place
        )
        SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
            coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(way.c, 0) AS cost, coalesce(way.a, '') AS audit,
            sha256(coalesce(substr(way.t, 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) e
        LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
        LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM e.conv_id
    """,
    "op13_spanning_bounds": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
            FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
        ), p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, positive_id, row_number() OVER w AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 5
    """,
}
