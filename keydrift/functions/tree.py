"""JSON documents as columns: marking, opening objects, ordering keys, rendering.

A document stays text. Before it is walked, every string token gets the prefix ``s``, so that
after ``from_json`` a value's first character tells its kind: ``s`` string, ``{`` object,
``[`` array, anything else a number, ``true``, ``false`` or ``null``. ``from_json`` to a map
keeps document order and returns nested values as compact text, so each level of a document is
opened by one call and no schema is needed.

Walks are single column expressions (``aggregate`` over levels), evaluated inside the row that
holds the document: no shuffle, no depth limit in the plan, no effect of a hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from keydrift.functions.text import (
    JSON_SPACE,
    STRING_TOKEN,
    choose,
    js_number,
    js_numbers_in,
    let,
    lower_hex_escapes,
    quoted,
)

STRING_BODY = STRING_TOKEN.replace('"[', '"([', 1)[:-1] + ')"'
# Keys that enumerate first, in numeric order, are integers below this bound.
INDEX_KEY = "^(?:0|[1-9][0-9]{0,9})$"
INDEX_KEY_BOUND = 4294967295
#: Levels of brackets that are told by replacements; deeper documents are followed bracket by bracket.
_PEELED = 8
#: Strict JSON without limits on the lengths of numbers and strings.
JSON_OPTIONS = {
    "maxNumLen": "2147483647",
    "maxStringLen": "2147483647",
    "allowSingleQuotes": "false",
    "allowNonNumericNumbers": "false",
}


# --- opening documents -------------------------------------------------------------------


def marked(json: Column) -> Column:
    """The document with every string token (keys too) prefixed by ``s``."""
    return F.regexp_replace(
        F.btrim(json, F.lit(JSON_SPACE)), F.lit(STRING_BODY), F.lit('"s$1"')
    )


def unmarked(json: Column) -> Column:
    """Undo :func:`marked` on compact text: only an unescaped quote can precede a mark."""
    return F.regexp_replace(json, F.lit(r'(?<!\\)"s'), F.lit('"'))


def is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(value, F.lit("{")), F.lit(False))


def is_array(value: Column) -> Column:
    return F.coalesce(F.startswith(value, F.lit("[")), F.lit(False))


def kind_of(value: Column) -> Column:
    """``object``, ``array``, ``string``, ``number``, ``boolean`` or ``null`` of a marked value."""
    first = F.substring(value, 1, 1)
    return (
        F.when(first == "{", "object")
        .when(first == "[", "array")
        .when(first == "s", "string")
        .when(first.isin("t", "f"), "boolean")
        .when(first == "n", "null")
        .otherwise("number")
    )


def open_object(value: Column) -> Column:
    """Marked object text → map of marked key to marked value, in document order.

    The text comes from a document that was checked as a whole, with the same options.
    """
    members = F.coalesce(F.from_json(value, "map<string,string>", JSON_OPTIONS), empty_object())
    return let(
        members,
        lambda m: F.map_from_arrays(
            F.map_keys(m), F.transform(F.map_values(m), lambda v: F.coalesce(v, F.lit("null")))
        ),
    )


def open_array(value: Column) -> Column:
    return F.transform(
        F.from_json(value, "array<string>", JSON_OPTIONS), lambda v: F.coalesce(v, F.lit("null"))
    )


def empty_object() -> Column:
    return F.create_map().cast("map<string,string>")


def open_target(value: Column) -> Column:
    """Members of a target value: an array's elements under their indexes, none of a scalar."""
    elements = F.transform(
        open_array(value), lambda v, i: F.struct(F.concat(F.lit("s"), i.cast("string")).alias("key"), v.alias("value"))
    )
    return (
        F.when(is_object(value), open_object(value))
        .when(is_array(value), F.map_from_entries(elements))
        .otherwise(empty_object())
    )


def key_text(marked_key: Column) -> Column:
    return F.substring(marked_key, F.lit(2), F.length(marked_key))


def is_index_key(key: Column) -> Column:
    # Most keys begin with no digit, which takes no regular expression to tell.
    digit_first = (key >= F.lit("0")) & (key < F.lit(":"))
    return digit_first & F.rlike(key, F.lit(INDEX_KEY)) & (key.cast("bigint") < INDEX_KEY_BOUND)


def rank_of(key: Column, position: Column) -> Column:
    """Two numbers that sort siblings: index keys by value, then the others by position."""
    return choose(
        is_index_key(key),
        F.array(F.lit(0).cast("bigint"), key.cast("bigint")),
        F.array(F.lit(1).cast("bigint"), position.cast("bigint")),
    )


def paired_members(first: Column, second: Column) -> Column:
    """Members of two opened objects by key: those of ``first`` in order, then the rest."""
    return F.map_entries(
        F.map_zip_with(
            first, second, lambda _, a, b: F.struct(a.alias("a"), b.alias("b"))
        )
    )


def nesting_depth(value: Column) -> Column:
    """How many brackets are open at most at any point of a JSON text.

    Taking all empty pairs out of balanced brackets lowers their depth by one, so a few replacements
    tell that of most documents. What is deeper, or not balanced, is followed bracket by bracket.
    """
    brackets = F.regexp_replace(value, F.lit(STRING_TOKEN + r'|[^\[\]{}"]++'), F.lit(""))

    def peeled(every: Column, rest: Column, depth: int) -> Column:
        below = (
            let(F.replace(rest, F.lit("{}"), F.lit("")), lambda less: peeled(every, less, depth + 1))
            if depth < _PEELED
            else _followed_depth(every)
        )
        return choose(rest == "", F.lit(depth), below)

    return F.coalesce(let(F.translate(brackets, "[]", "{}"), lambda every: peeled(every, every, 0)), F.lit(0))


def _followed_depth(brackets: Column) -> Column:
    steps = F.split(brackets, "")

    def follow(state: Column, bracket: Column) -> Column:
        step = F.when(bracket == "{", 1).when(bracket == "}", -1).otherwise(0)
        return F.struct(
            (state["now"] + step).alias("now"),
            F.greatest(state["deepest"], state["now"] + step).alias("deepest"),
        )

    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("deepest"))
    return F.aggregate(steps, start, follow)["deepest"]


def levels(*values: Column) -> Column:
    """One element per level to open, and one for a scalar. Every round of a fold copies its state,
    so the number of rounds is the documents' own depth and no more."""
    return F.sequence(F.lit(1), F.greatest(F.lit(1), *(nesting_depth(v) for v in values)))


# --- rendering ---------------------------------------------------------------------------

#: What only a line that is still to be opened has, is in ``rest``.
_LINE = (
    "struct<ordinal:array<int>,text:string,source:string,path:array<string>,hit:boolean,"
    "rest:struct<pad:string,tail:string,target:string,picked:array<array<string>>>>"
)
_MEMBERS = "array<struct<key:string,source:string,target:string,hit:boolean>>"


def scalar_json(value: Column) -> Column:
    """A marked scalar as JSON text."""
    number = choose(F.rlike(value, F.lit("^[-0-9]")), js_number(value), value)
    return choose(F.startswith(value, F.lit("s")), quoted(key_text(value)), number)


def compact_json(value: Column) -> Column:
    """A marked value as compact JSON text, keys in enumeration order, repeats removed."""
    fast = js_numbers_in(lower_hex_escapes(unmarked(value)))
    keys = F.array_remove(
        F.regexp_extract_all(value, F.lit(f"({STRING_TOKEN}):|{STRING_TOKEN}"), F.lit(1)), ""
    )
    plain_keys = ~F.rlike(value, F.lit('"s[0-9]++":')) & (
        F.size(keys) == F.size(F.array_distinct(keys))
    )
    nested = is_object(value) | is_array(value)
    rebuilt = F.array_join(
        F.transform(rendered_lines(value, indent=0), lambda line: line["text"]), ""
    )
    return (
        F.when(~nested, scalar_json(value)).when(plain_keys, fast).otherwise(rebuilt)
    )


def rendered_lines(
    value: Column,
    source: Column | None = None,
    picked: Column | None = None,
    indent: int = 2,
) -> Column:
    """Lines of the printed document, as ``array<struct<ordinal, text, path, hit, source, …>>``.

    With ``source``, keys of ``source`` that ``value`` lacks are taken over on the way; ``hit`` marks
    the line where each of them starts and ``source`` holds its marked value there. ``picked`` (array
    of paths) restricts which; without it all are. Finished lines leave the fold with the ordinal of
    their place, so that a level costs what it opens.
    """
    source = F.lit(None).cast("string") if source is None else source
    root = _line(
        ordinal=F.array().cast("array<int>"),
        text=F.lit(""),
        source=source,
        path=F.array().cast("array<string>"),
        hit=F.lit(False),
        rest=_line(
            pad=F.lit(""),
            tail=F.lit(""),
            target=value,
            picked=F.lit(None).cast("array<array<string>>") if picked is None else picked,
        ),
    )
    start = F.struct(
        F.array().cast(f"array<{_LINE}>").alias("found"),
        F.array(root).cast(f"array<{_LINE}>").alias("open"),
    )

    def next_level(state: Column, _: Column) -> Column:
        advanced = let(
            F.flatten(F.transform(state["open"], lambda line: _expand(line, picked is not None, indent))),
            lambda lines: F.struct(
                F.flatten(F.array(state["found"], F.filter(lines, lambda line: line["rest"].isNull()))).alias("found"),
                F.filter(lines, lambda line: line["rest"].isNotNull()).alias("open"),
            ),
        )
        return choose(F.size(state["open"]) == 0, state, advanced)

    return F.sort_array(F.aggregate(levels(source, value), start, next_level)["found"])


def _line(**fields: Column) -> Column:
    return F.struct(*(c.alias(n) for n, c in fields.items()))


def _member(key: Column, source: Column, target: Column, hit: Column) -> Column:
    return F.struct(
        key.alias("key"), source.alias("source"), target.alias("target"), hit.alias("hit")
    )


def _expand(line: Column, picked: bool, indent: int) -> Column:
    """One open line → its own line and, for a container, its members and closing line."""
    return let(
        _contents(line, picked), lambda inside: _lines_of(line, inside, indent)
    )


def _contents(line: Column, picked: bool) -> Column:
    """Kind (first character) and members of a line's value after taking over missing keys."""
    target = line["rest"]["target"]
    value = F.coalesce(target, line["source"])
    as_is = F.struct(
        F.substring(value, 1, 1).alias("kind"),
        F.when(
            is_object(value),
            F.transform(
                F.map_entries(open_object(value)),
                lambda e: _member(
                    key_text(e["key"]), F.lit(None).cast("string"), e["value"], F.lit(False)
                ),
            ),
        )
        .when(
            is_array(value),
            F.transform(
                open_array(value),
                lambda v: _member(
                    F.lit(None).cast("string"), F.lit(None).cast("string"), v, F.lit(False)
                ),
            ),
        )
        .otherwise(F.array().cast(_MEMBERS))
        .alias("members"),
    )
    shared = (
        is_object(line["source"])
        & target.isNotNull()
        & (line["source"] != target)
    )

    def chosen(opened: Column) -> Column:
        """Members of source, then of target, as (key, a, b, taken). Choices are matched by hash as a third side."""
        both = F.map_zip_with(
            opened["source"], opened["target"], lambda _, a, b: F.struct(a.alias("a"), b.alias("b"))
        )
        here = F.transform(
            F.filter(line["rest"]["picked"], lambda p: F.size(p) == 1),
            lambda p: F.struct(F.concat(F.lit("s"), p[0]).alias("key"), F.lit(True).alias("value")),
        )
        marks = F.map_zip_with(
            both, F.map_from_entries(here), lambda _, side, t: F.struct(side.alias("side"), t.isNotNull().alias("taken"))
        )
        return F.transform(
            F.filter(F.map_entries(marks), lambda e: e["value"]["side"].isNotNull()),
            lambda e: F.struct(e["key"].alias("key"), e["value"]["side"].alias("side"), e["value"]["taken"].alias("taken")),
        )

    def merged(opened: Column) -> Column:
        # Where no keys are chosen, each one is taken that the target lacks.
        every = F.transform(
            paired_members(opened["source"], opened["target"]),
            lambda e: _member(key_text(e["key"]), e["value"]["a"], e["value"]["b"], e["value"]["b"].isNull()),
        )
        by_source = every if not picked else F.filter(
            F.transform(
                chosen(opened),
                lambda e: _member(
                    key_text(e["key"]),
                    e["side"]["a"],
                    e["side"]["b"],
                    e["side"]["b"].isNull() & e["taken"],
                ),
            ),
            lambda m: m["target"].isNotNull() | m["hit"],
        )
        by_target = F.transform(
            F.filter(
                paired_members(opened["target"], opened["source"]),
                lambda e: e["value"]["a"].isNotNull(),
            ),
            lambda e: _member(
                key_text(e["key"]), e["value"]["b"], e["value"]["a"], F.lit(False)
            ),
        )
        return let(
            by_source,
            lambda ordered: F.when(
                F.exists(ordered, lambda m: m["hit"]),
                F.struct(F.lit("{").alias("kind"), ordered.alias("members")),
            )
            .when(
                is_object(target),
                F.struct(F.lit("{").alias("kind"), by_target.alias("members")),
            )
            .otherwise(as_is),
        )

    both = F.struct(
        open_object(line["source"]).alias("source"),
        open_target(target).alias("target"),
    )
    return choose(shared, let(both, merged), as_is)


def _enumerated(members: Column) -> Column:
    """Members with index keys first, ascending; the others keep their order."""
    indexed = F.array_sort(
        F.filter(members, lambda m: is_index_key(m["key"])),
        lambda x, y: F.signum(x["key"].cast("bigint") - y["key"].cast("bigint")).cast("int"),
    )
    rest = F.filter(members, lambda m: ~F.coalesce(is_index_key(m["key"]), F.lit(False)))
    has_index = F.exists(
        members, lambda m: F.coalesce(is_index_key(m["key"]), F.lit(False))
    )
    return choose(has_index, F.concat(indexed, rest), members)


def _lines_of(line: Column, inside: Column, indent: int) -> Column:
    kind, rest = inside["kind"], line["rest"]
    value = F.coalesce(rest["target"], line["source"])
    opening, closing = kind, choose(kind == "{", F.lit("}"), F.lit("]"))
    step, colon = " " * indent, '": ' if indent else '":'

    def closed(
        ordinal: Column, text: Column, hit: Column, given: Column, path: Column = line["path"]
    ) -> Column:
        return _line(
            ordinal=ordinal,
            text=text,
            source=F.when(hit, given),
            path=path,
            hit=hit,
            rest=F.lit(None).cast(_LINE.partition("rest:")[2][:-1]),
        )

    def child(member: Column, position: Column, count: Column) -> Column:
        pad = F.concat(rest["pad"], F.lit(step))
        label = choose(member["key"].isNull(), F.lit(""), F.concat(quoted(member["key"]), F.lit(colon[1:])))
        tail = choose(position < count - 1, F.lit(","), F.lit(""))
        path = F.array_append(line["path"], member["key"])
        ordinal = F.array_append(line["ordinal"], position)
        given = F.coalesce(member["target"], member["source"])
        below = F.transform(
            F.filter(rest["picked"], lambda p: (F.size(p) > 1) & (p[0] == member["key"])),
            lambda p: F.slice(p, F.lit(2), F.size(p)),
        )
        is_open = (
            is_object(given)
            | is_array(given)
            | (is_object(member["source"]) & member["target"].isNotNull())
        )
        opened = _line(
            ordinal=ordinal,
            text=F.concat(pad, label),
            source=member["source"],
            path=path,
            hit=member["hit"],
            rest=_line(
                pad=pad, tail=tail, target=member["target"], picked=F.when(F.size(rest["picked"]) > 0, below)
            ),
        )
        finished = closed(
            ordinal, F.concat(pad, label, scalar_json(given), tail), member["hit"], given, path
        )
        return choose(is_open, opened, finished)

    def container(members: Column) -> Column:
        count = F.size(members)
        return choose(
            count == 0,
            F.array(closed(line["ordinal"], F.concat(line["text"], opening, closing, rest["tail"]), line["hit"], value)),
            F.flatten(
                F.array(
                    F.array(closed(line["ordinal"], F.concat(line["text"], opening), line["hit"], value)),
                    F.transform(members, lambda m, i: child(m, i, count)),
                    F.array(
                        closed(
                            F.array_append(line["ordinal"], count),
                            F.concat(rest["pad"], closing, rest["tail"]),
                            F.lit(False),
                            value,
                        )
                    ),
                )
            )
        )

    return choose(
        kind.isin("{", "["),
        let(_enumerated(inside["members"]), container),
        F.array(
            closed(line["ordinal"], F.concat(line["text"], scalar_json(value), rest["tail"]), line["hit"], value)
        )
    )
