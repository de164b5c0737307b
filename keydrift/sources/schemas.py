"""Table schemas."""

from pyspark.sql.types import (
    ArrayType,
    IntegerType,
    LongType,
    StringType,
    StructType,
    TimestampType,
)

TEXT, TIME = StringType(), TimestampType()


def _catalog(*fields: tuple[str, bool]) -> StructType:
    """``id``, the given text fields as (name, nullable), and the audit columns."""
    schema = StructType().add("id", TEXT, False)
    for name, nullable in fields:
        schema = schema.add(name, TEXT, nullable)
    return (
        schema.add("create_by", TEXT, False)
        .add("create_at", TIME)
        .add("update_by", TEXT)
        .add("update_at", TIME)
    )


USERS = _catalog(("email", False), ("role", False))
QUERIES = _catalog(("title", False), ("query", False), ("hos_use", True))
NOTES = _catalog(("note", False), ("description", False))
PAIRS = (
    StructType().add("pair_id", LongType()).add("target_json", TEXT).add("source_json", TEXT)
)
HISTORY = (
    StructType()
    .add("pair_id", LongType())
    .add("ts", TIME)
    .add("batch_seq", IntegerType())
    .add("path", ArrayType(TEXT))
    .add("value_json", TEXT)
    .add("type", TEXT)
)


def changes_schema(*editable: str) -> StructType:
    """A change feed over a catalog: ``op`` I, U or D, ordered by ``seq`` within an id."""
    schema = StructType().add("op", TEXT).add("seq", LongType()).add("id", TEXT)
    schema = schema.add("actor", TEXT).add("at", TIME)
    for name in editable:
        schema = schema.add(name, TEXT)
    return schema
