"""Parse checks on document pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from keydrift.functions.text import JSON_SPACE, is_blank, let
from keydrift.functions.tree import JSON_OPTIONS, is_array, is_object, marked, nesting_depth

# Messages shown for a document.
INVALID_JSON = "Invalid JSON"
NOT_AN_OBJECT = "Target is not an object"
#: For documents that Spark's parser cannot read whether valid or not: a key of 50,000 characters or more,
#: or about 1,000 levels. Other lengths (of strings, numbers, texts) have no limit of their own.
BEYOND_LIMITS = "Beyond parser limits"
LONGEST_NAME, DEEPEST = 50_000, 999


def valid_marks(text: Column) -> Column:
    """The marked text of exactly one JSON value, NULL for any other text; a single pass over the document.

    The marked text, which is what a walk opens later, is placed in an array in front of its own
    digest: only a single complete value leaves the digest in second and last place.
    """
    digest = F.sha2(text, 256)

    def checked(marks: Column) -> Column:
        framed = F.concat(F.lit("["), marks, F.lit(',"'), digest, F.lit('"]'))
        parsed = F.from_json(framed, "array<string>", JSON_OPTIONS)
        single = let(parsed, lambda values: (F.size(values) == 2) & (F.get(values, F.lit(1)) == digest))
        return F.when(single, marks)

    return let(marked(text), checked)


def is_valid_json(text: Column) -> Column:
    """Strict validity: exactly one JSON value."""
    return valid_marks(text).isNotNull()


def is_beyond_limits(text: Column) -> Column:
    """Whether a text that could not be parsed has a key or a depth that no text can be parsed with."""
    long_name = F.rlike(text, F.lit(f'"[^"]{{{LONGEST_NAME - 1},}}"[ \\t\\n\\r]*+:'))
    return F.coalesce(long_name | (nesting_depth(text) > DEEPEST), F.lit(False))


def error_of(text: Column, marks: Column) -> Column:
    """For non-blank text without :func:`valid_marks` ``Invalid JSON`` or ``Beyond parser limits``, else NULL."""
    wrong = marks.isNull() & ~is_blank(text)
    return F.when(wrong, F.when(is_beyond_limits(text), BEYOND_LIMITS).otherwise(INVALID_JSON))


def json_error(text: Column) -> Column:
    """For non-blank text that is not one JSON value ``Invalid JSON`` or ``Beyond parser limits``, else NULL."""
    return error_of(text, valid_marks(text))


def is_truthy_json(text: Column) -> Column:
    """For a valid text: not ``null``, ``false``, ``""`` or a zero."""
    value = F.btrim(text, F.lit(JSON_SPACE))
    zero = F.coalesce(value.try_cast("double") == 0, F.lit(False))
    return ~(value.isin("null", "false", '""') | zero)


def is_comparable(target: Column, source: Column) -> Column:
    """Both sides present, valid and truthy; anything else has an empty comparison."""
    return (
        ~is_blank(target)
        & ~is_blank(source)
        & is_valid_json(target)
        & is_valid_json(source)
        & is_truthy_json(target)
        & is_truthy_json(source)
    )


def has_members(text: Column) -> Column:
    """A JSON object with at least one member."""
    value = F.btrim(text, F.lit(JSON_SPACE))
    return is_object(value) & ~F.rlike(value, F.lit(r"^\{[ \t\n\r]*+\}"))


def is_container(text: Column) -> Column:
    value = F.btrim(text, F.lit(JSON_SPACE))
    return is_object(value) | is_array(value)


def has_shape(target: Column, source: Column) -> Column:
    """An object against a container, by their first characters; such texts are neither blank nor falsy."""
    return is_object(F.btrim(source, F.lit(JSON_SPACE))) & is_container(target)


def can_walk(target: Column, source: Column) -> Column:
    """Pairs that can have missing keys: comparable, an object against a container."""
    return has_shape(target, source) & is_valid_json(target) & is_valid_json(source)


def with_status(pairs: DataFrame) -> DataFrame:
    """Add ``target_error``, ``source_error``, ``comparable`` and ``error`` to pairs.

    ``error`` reports a target that is a truthy scalar while the source has keys to offer.
    """
    target, source = F.col("target_json"), F.col("source_json")
    checked = pairs.withColumns(
        {"target_error": json_error(target), "source_error": json_error(source)}
    )
    both_given = ~is_blank(target) & ~is_blank(source)
    no_error = F.col("target_error").isNull() & F.col("source_error").isNull()
    return checked.withColumn(
        "comparable",
        F.coalesce(
            both_given & no_error & is_truthy_json(target) & is_truthy_json(source),
            F.lit(False),
        ),
    ).withColumn(
        "error",
        F.when(
            F.col("comparable") & ~is_container(target) & has_members(source), NOT_AN_OBJECT
        ),
    )
