"""String rules of the comparison: blank text, JSON quoting, number rendering."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Every character a script engine's trim() removes.
TRIM_CHARS = (
    "\t\n\x0b\x0c\r   "
    "           "
    "    　﻿"
)
# Fixed value: the only whitespace allowed between JSON tokens.
JSON_SPACE = " \t\n\r"

# One JSON string token. The possessive quantifiers keep long strings off the regex stack.
STRING_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
NUMBER_TOKEN = r"-?[0-9][0-9.eE+\-]*+"

SEGMENT_SEPARATOR = " > "


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(TRIM_CHARS))


def is_blank(text: Column) -> Column:
    """True for NULL, empty and whitespace-only text."""
    return ~F.coalesce(F.rlike(text, F.lit(f"[^{TRIM_CHARS}]")), F.lit(False))


def none_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def display_path(path: Column) -> Column:
    return F.array_join(path, SEGMENT_SEPARATOR)


def quoted(text: Column) -> Column:
    """Text as a JSON string token."""
    needs_escape = F.rlike(text, F.lit(r'[\x00-\x1f"\\]'))
    encoded = F.to_json(F.array(text))
    encoded = F.substring(encoded, F.lit(2), F.length(encoded) - 2)
    return choose(needs_escape, lower_hex_escapes(encoded), F.concat(F.lit('"'), text, F.lit('"')))


def lower_hex_escapes(json: Column) -> Column:
    """Rewrite ``\\u001F`` as ``\\u001f``: control characters are written with lower-case hex."""
    result = json
    for prefix, digits in (("0", "BEF"), ("1", "ABCDEF")):
        for digit in digits:
            result = F.regexp_replace(
                result,
                F.lit(r"(?<!\\)((?:\\\\)*+)\\u00" + prefix + digit),
                F.lit(r"$1\\u00" + prefix + digit.lower()),
            )
    return F.when(F.contains(json, F.lit("\\u00")), result).otherwise(json)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    A fold over no elements hands its start value to the finishing step as it is; binding
    through ``transform`` would copy the value.
    """
    nothing = F.array().cast("array<int>")
    return F.aggregate(nothing, value, lambda held, _: held, body)


def choose(condition: Column, yes: Column, no: Column) -> Column:
    """``when(condition, yes).otherwise(no)``, in the form that costs less inside lambdas, which are interpreted."""
    return F.call_function("if", condition, yes, no)


def js_number(token: Column) -> Column:
    """A JSON number token as a script engine prints it: a double, shortest digits.

    Plain decimals from 1e-6 up to 1e21, exponent form beyond, no trailing ``.0``,
    no negative zero, and ``null`` for a value outside the double range.
    """
    return choose(
        F.rlike(token, F.lit("^(?:0|-?[1-9][0-9]{0,14})$")), token, let(token.cast("double"), _render_double)
    )


def _render_double(value: Column) -> Column:
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    shown = F.abs(value).cast("string")
    mantissa = F.substring_index(shown, "E", 1)
    exponent = F.when(
        F.contains(shown, F.lit("E")), F.substring_index(shown, "E", -1).cast("int")
    ).otherwise(F.lit(0))
    whole = F.substring_index(mantissa, ".", 1)
    every_digit = F.replace(mantissa, F.lit("."), F.lit(""))
    significant = F.regexp_replace(every_digit, F.lit("^0+"), F.lit(""))
    skipped = F.length(every_digit) - F.length(significant)
    parts = F.struct(
        F.regexp_replace(significant, F.lit("0+$"), F.lit("")).alias("digits"),
        (F.length(whole) + exponent - skipped).alias("point"),
    )
    rendered = let(parts, lambda p: _place_point(p["digits"], p["point"]))
    return (
        F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit("null"))
        .when(value == 0, F.lit("0"))
        .otherwise(F.concat(sign, rendered))
    )


def _place_point(digits: Column, point: Column) -> Column:
    zeros = lambda n: F.repeat(F.lit("0"), n)
    count = F.length(digits)
    power = point - 1
    tail = F.substring(digits, F.lit(2), count)
    return (
        F.when((count <= point) & (point <= 21), F.concat(digits, zeros(point - count)))
        .when(
            (point > 0) & (point <= 21),
            F.concat(
                F.substring(digits, F.lit(1), point),
                F.lit("."),
                F.substring(digits, point + 1, count),
            ),
        )
        .when((point > -6) & (point <= 0), F.concat(F.lit("0."), zeros(-point), digits))
        .otherwise(
            F.concat(
                F.substring(digits, F.lit(1), F.lit(1)),
                F.when(tail != "", F.concat(F.lit("."), tail)).otherwise(F.lit("")),
                F.when(power > 0, F.lit("e+")).otherwise(F.lit("e-")),
                F.abs(power).cast("string"),
            )
        )
    )


def js_numbers_in(json: Column) -> Column:
    """Render every number token of a compact JSON text with :func:`js_number`."""
    tokens = F.regexp_extract_all(
        json, F.lit(f"{STRING_TOKEN}|{NUMBER_TOKEN}|[^\"0-9\\-]++"), F.lit(0)
    )
    rewritten = F.array_join(
        F.transform(
            tokens,
            lambda t: F.when(F.rlike(t, F.lit("^[-0-9]")), js_number(t)).otherwise(t),
        ),
        "",
    )
    suspicious = F.rlike(json, F.lit(r"[0-9][.eE]|[0-9]{16}|-0"))
    return F.when(suspicious, rewritten).otherwise(json)
