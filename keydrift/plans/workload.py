"""Large inputs for the operators, derived from whole tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from keydrift.plans.session import configure
from keydrift.sources.tables import ordered, spread

# The same expressions run in Spark and in the checking SQL.
SOURCE_JSON = """'{"key":' || o_orderkey || ',"cust":{"id":' || o_custkey || ',"tier":"'
 || o_orderpriority || '"},"status":"' || o_orderstatus || '","db":{"pool":{"min":1,"max":'
 || (o_orderkey % 50) || '}},"flags":[1,{"k":2}]}'"""
TARGET_JSON = """'{' || CASE WHEN o_orderkey % 4 = 1 THEN '"only_target":null,' ELSE '' END
 || '"key":' || o_orderkey
 || CASE WHEN o_orderkey % 5 = 0 THEN ',"cust":5'
         WHEN o_orderkey % 3 = 0 THEN ',"cust":{"id":' || o_custkey || '}'
         ELSE ',"cust":{"id":0,"tier":"x"}' END
 || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE ',"status":"X"' END
 || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE ',"db":{"pool":{}}' END
 || CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE ',"flags":[9]' END
 || CASE WHEN o_orderkey % 4 = 1 THEN '' ELSE ',"only_target":null' END || '}'"""


# Documents as awkward pairs: index keys, a repeated key, null values, escapes, blanks between tokens, six levels,
# arrays of objects; targets that are arrays, scalars, blank or no JSON.
HARD_SOURCE = """' { "10" : ' || doc_id || ',"2":"' || escaped || '", "o":{"a":null,"b":[{"x":1}],
 "d1":{"d2":{"d3":{"d4":{"d5":{"d6":' || doc_id || '}}}}}},"o2":"v","o2":"w" }'"""
HARD_TARGET = """CASE doc_id % 7 WHEN 0 THEN '{}' WHEN 1 THEN '{ "o": {"a": 0} }' WHEN 2 THEN '[1,2,3]'
 WHEN 3 THEN '{bad' WHEN 4 THEN '  ' WHEN 5 THEN '7' ELSE '{"o":{"d1":{"d2":{}}},"2":null}' END"""


def hard_pairs(spark: SparkSession, folder: str) -> DataFrame:
    escaped = F.replace(
        F.replace(F.replace(F.col("text"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")
    )
    documents = spread(table(spark, folder, "documents")).select("doc_id", escaped.alias("escaped"))
    return documents.selectExpr(
        "doc_id AS pair_id", f"{HARD_TARGET} AS target_json", f"{HARD_SOURCE} AS source_json"
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


def config_pairs(spark: SparkSession, folder: str, in_order: bool = False) -> DataFrame:
    """Orders as pairs of documents; ``in_order`` sorts them by pair before the documents are made."""
    orders = table(spark, folder, "orders")
    orders = ordered(orders, "o_orderkey") if in_order else spread(orders)
    return orders.selectExpr(
        "o_orderkey AS pair_id", f"{TARGET_JSON} AS target_json", f"{SOURCE_JSON} AS source_json"
    )


def import_choice(spark: SparkSession, folder: str) -> DataFrame:
    """Two keys chosen on every third pair; the choice does nothing where they are present."""
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey AS pair_id",
        "explode(CASE WHEN o_orderkey % 3 = 0 THEN array(array('cust', 'tier'), array('status')) "
        "ELSE CAST(array() AS array<array<string>>) END) AS path",
    )


def baselines(spark: SparkSession, folder: str) -> DataFrame:
    """One baseline document per customer segment."""
    return table(spark, folder, "customer").groupBy("c_mktsegment").agg({"c_custkey": "max"}).selectExpr(
        "c_mktsegment AS baseline_id",
        """'{"seg":"' || c_mktsegment || '","acct":{"id":' || `max(c_custkey)` || '}}' AS target_json""",
    )


def baseline_sources(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "customer")).selectExpr(
        "c_custkey AS pair_id",
        "c_mktsegment AS baseline_id",
        """'{"seg":"s","acct":{"id":' || c_custkey || ',"nation":' || c_nationkey || '},"name":"'
           || c_name || '"}' AS source_json""",
    )


def checked_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Valid JSON, JSON with something behind it, and whole texts and pages that are not JSON."""
    events = table(spark, folder, "events").selectExpr(
        "'event' AS origin",
        "event_id AS id",
        """CASE event_id % 5 WHEN 0 THEN props || ' x' WHEN 1 THEN '[' || props || ',null]'
           WHEN 2 THEN '  ' ELSE props END AS text""",
    )
    documents = table(spark, folder, "documents").selectExpr(
        "'document' AS origin", "doc_id AS id", "text"
    )
    pages = table(spark, folder, "pages").selectExpr("'page' AS origin", "page_id AS id", "html AS text")
    return events.unionByName(documents).unionByName(pages)


def saved_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as a catalog of saved queries."""
    return table(spark, folder, "documents").selectExpr(
        "CAST(doc_id AS STRING) AS id",
        "source AS title",
        "text AS query",
        "CASE WHEN doc_id % 9 = 0 THEN '' WHEN doc_id % 10 = 0 THEN NULL ELSE lang END AS hos_use",
        "CASE WHEN doc_id % 50 <> 0 THEN timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, "
        "CAST(doc_id % 97 AS INT)) END AS create_at",
    )


def event_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a catalog with more rows than one listing shows."""
    return table(spark, folder, "events").selectExpr(
        "CAST(event_id AS STRING) AS id",
        "event_type AS title",
        "props AS query",
        "'HOS-' || (user_id % 20) AS hos_use",
        "CASE WHEN event_id % 500 <> 0 THEN CAST(ts AS TIMESTAMP) END AS create_at",
    )


def saved_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as notes."""
    return table(spark, folder, "conversations").selectExpr(
        "conv_id || '-' || turn AS id",
        "role AS note",
        "text AS description",
        "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, CAST(conv_id % 31 AS INT)) AS create_at",
    )


def note_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as stored notes."""
    return table(spark, folder, "customer").selectExpr(
        "CAST(c_custkey AS STRING) AS id",
        "c_name AS note",
        "c_mktsegment AS description",
        "'system' AS create_by",
        "timestamp'2023-01-01 00:00:00' AS create_at",
        "CAST(NULL AS STRING) AS update_by",
        "timestamp'2023-01-01 00:00:00' AS update_at",
    )


def note_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as a change feed over those notes, a third of it for ids that are not stored."""
    return table(spark, folder, "orders").selectExpr(
        "CASE WHEN o_orderkey % 7 = 0 THEN 'D' WHEN o_orderkey % 5 = 0 THEN 'I' ELSE 'U' END AS op",
        "o_orderkey AS seq",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'n' || o_custkey ELSE CAST(o_custkey AS STRING) END AS id",
        "CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderstatus END AS actor",
        "CAST(o_orderdate AS TIMESTAMP) AS at",
        "CASE WHEN o_orderkey % 13 = 0 THEN ' ' ELSE 'note ' || o_orderkey END AS note",
        "o_orderpriority AS description",
    )


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as user profiles; some ids are held twice."""
    customers = table(spark, folder, "customer")
    columns = [
        "CASE WHEN c_mktsegment = 'BUILDING' THEN 'deployer' ELSE 'support' END AS role",
        "'system' AS create_by",
        "timestamp'2023-01-01 00:00:00' AS create_at",
        "CAST(NULL AS STRING) AS update_by",
        "timestamp'2023-01-01 00:00:00' AS update_at",
    ]
    once = customers.selectExpr("CAST(c_custkey AS STRING) AS id", "c_name AS email", *columns)
    again = customers.where("c_custkey % 17 = 0").selectExpr(
        "CAST(c_custkey AS STRING) AS id", "c_name || '-2' AS email", *columns
    )
    return once.unionByName(again)


def logins(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as logins; every eleventh comes from a user without a profile."""
    return table(spark, folder, "orders").selectExpr(
        "o_orderkey AS login_no",
        "CASE WHEN o_orderkey % 11 = 0 THEN 'new' || o_custkey ELSE CAST(o_custkey AS STRING) END AS id",
        "CASE WHEN o_orderkey % 6 <> 0 THEN 'mail' || o_orderkey END AS email",
        "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, o_orderkey) AS login_at",
    )
