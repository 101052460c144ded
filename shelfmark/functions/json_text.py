"""JSON columns: validity, structure, root keys and depth of a JSON text column.

All of it stays in the JVM. Depth and structure are defined for valid texts only; the
callers in ``operators.semistructured`` apply the validity test first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE_NAMES = {
    "{": "object",
    "[": "array",
    '"': "string",
    "t": "boolean",
    "f": "boolean",
    "n": "null",
}


def is_valid_json(content: Column) -> Column:
    """One complete JSON value and nothing after it.

    The parser functions stop after the first value, so the text is tested inside an
    object and inside an array: what could follow a value in one cannot in the other.
    """
    in_object = F.try_parse_json(F.concat(F.lit('{"x":'), content, F.lit("}"))).isNotNull()
    in_array = F.json_array_length(F.concat(F.lit("["), content, F.lit("]"))) == 1
    return F.coalesce(in_object & in_array, F.lit(False))


def _type_of(text: Column) -> Column:
    first = F.substring(F.regexp_replace(text, r"^\s+", ""), 1, 1)
    name = F.lit("number")
    for start, type_name in TYPE_NAMES.items():
        name = F.when(first == start, F.lit(type_name)).otherwise(name)
    return F.when(first.isNotNull() & (first != ""), name)


def root_type(content: Column) -> Column:
    """object / array / string / number / boolean / null, from the first character."""
    return _type_of(content)


def root_keys(content: Column) -> Column:
    """Root keys in document order; empty for anything but an object."""
    return F.when(
        root_type(content) == "object", F.array_distinct(F.json_object_keys(content))
    ).otherwise(F.array().cast("array<string>"))


def item_types(content: Column, n: int | None = None) -> Column:
    """Sorted distinct type names of all items of an array, or of the first ``n``."""
    items = F.from_json(content, "array<variant>")
    if n is not None:
        items = F.slice(items, 1, n)
    names = F.transform(items, lambda item: _type_of(F.coalesce(F.to_json(item), F.lit("null"))))
    return F.array_sort(F.array_distinct(F.array_compact(names)))


# What Spark's JSON parser accepts, in levels of nesting and digits of a number.
PARSER_DEPTH = 1000
PARSER_DIGITS = 1000


def beyond_parser(content: Column) -> Column:
    """Whether a text nests deeper, or has a longer number, than the parser takes; a text of
    which it refuses to read is then not known to be invalid."""
    return (depth(content) >= PARSER_DEPTH) | content.rlike(rf"\d{{{PARSER_DIGITS - 10}}}")


def structure(content: Column, sample: int | None = None) -> Column:
    """Root type with key count and keys, or length and item types, or length.

    ``sample`` restricts the keys listed and the items looked at to the first ones.
    """
    kind = root_type(content)
    keys = root_keys(content)
    return F.struct(
        kind.alias("type"),
        F.when(kind == "object", F.size(keys)).cast("long").alias("key_count"),
        F.when(kind == "object", keys if sample is None else F.slice(keys, 1, sample)).alias("sample_keys"),
        F.when(kind == "array", F.json_array_length(content))
        .when(kind == "string", F.length(F.try_variant_get(F.try_parse_json(content), "$", "string")))
        .cast("long")
        .alias("length"),
        F.when(kind == "array", item_types(content, sample)).alias("sample_item_types"),
    )


def depth(content: Column) -> Column:
    """Deepest nesting; an empty container adds nothing and a scalar root is 0.

    Strings are blanked (escapes first, so that a quote always ends a string), empty
    containers become scalars, and the running bracket balance is maximised.
    """
    no_escapes = F.regexp_replace(content, r"\\.", "")
    no_strings = F.regexp_replace(no_escapes, r'"[^"]*"', "s")
    no_empties = F.regexp_replace(F.regexp_replace(no_strings, r"\s+", ""), r"\[\]|\{\}", "s")
    brackets = F.regexp_extract_all(no_empties, F.lit(r"[\[\]{}]"), 0)
    walked = F.aggregate(
        brackets,
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda acc, b: F.struct(
            (acc["now"] + F.when(b.isin("[", "{"), 1).otherwise(-1)).alias("now"),
            F.greatest(
                acc["most"], acc["now"] + F.when(b.isin("[", "{"), 1).otherwise(0)
            ).alias("most"),
        ),
        lambda acc: acc["most"],
    )
    return walked.cast("long")
