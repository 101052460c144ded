"""JSON and YAML profiles of a content column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import PREVIEW_CHARS
from ..functions import json_text as jt
from ..functions.arrow import map_texts

JSON_ERROR = "not a single valid JSON value"
NOT_JUDGED = "deeper nesting or longer numbers than the parser takes; not judged"
TRUNCATED = "text is longer than the limit and was not parsed"


def json_validity(df: DataFrame, content: str = "content") -> DataFrame:
    """Add ``json_valid`` and, for invalid texts, ``json_error``.

    A text that only the parser's size limits keep from being read is not judged:
    ``json_valid`` is null and the error says so.
    """
    text = F.col(content)
    judged = F.when(text.isNull(), F.lit(False)).otherwise(json_judgement(text))
    return df.withColumn("json_valid", judged).withColumn(
        "json_error", _json_error(text, F.col("json_valid"), F.lit(False))
    )


def _json_error(content: Column, valid: Column, too_long: Column) -> Column:
    return (
        F.when(too_long, F.lit(TRUNCATED))
        .when(~valid, F.lit(JSON_ERROR))
        .when(content.isNotNull() & valid.isNull(), F.lit(NOT_JUDGED))
    )


def _json_fields(content: Column, valid: Column, too_long: Column) -> dict[str, Column]:
    """The JSON fields; ``valid`` is null for a text that is too long to be judged."""
    return {
        "json_valid": valid,
        "json_error": _json_error(content, valid, too_long),
        "json_truncated": too_long,
        "json_structure": F.when(valid, jt.structure(content)),
        "json_root_keys": F.when(valid, jt.root_keys(content)),
        "json_root_key_count": F.when(valid, F.size(jt.root_keys(content)).cast("long")),
        "json_depth": F.when(valid, jt.depth(content)),
        "json_size": F.when(valid, F.length(content).cast("long")),
    }


def _too_long(content: Column, max_chars: int | None) -> Column:
    return F.lit(False) if max_chars is None else F.length(content) > max_chars


def json_judgement(content: Column, max_chars: int | None = None) -> Column:
    """Is the text valid JSON? Null for null, for a text longer than ``max_chars`` and for
    one that only the parser's limits of depth and digits keep from being read."""
    known = content.isNotNull() & ~_too_long(content, max_chars)
    valid = jt.is_valid_json(content)
    return F.when(known, F.when(valid, valid).when(~jt.beyond_parser(content), valid))


def json_struct(content: Column, valid: Column, max_chars: int | None = None) -> Column:
    """All JSON fields as one struct, given the judgement of ``json_judgement``.

    The whole text is parsed by default. With ``max_chars`` a longer text is flagged
    ``json_truncated`` and not judged.
    """
    fields = _json_fields(content, valid, _too_long(content, max_chars))
    fields["content_preview"] = F.when(valid, F.substring(content, 1, PREVIEW_CHARS))
    fields["error"] = fields["json_error"]
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def json_profile(
    df: DataFrame, content: str = "content", max_chars: int | None = None
) -> DataFrame:
    """Add the JSON fields: validity, structure, root keys, depth and size.

    Every field is a column of its own, so a query computes only those it uses.
    """
    text = F.col(content)
    too_long = _too_long(text, max_chars)
    judged = df.withColumn("json_valid", json_judgement(text, max_chars))
    fields = _json_fields(text, F.col("json_valid"), too_long)
    del fields["json_valid"], fields["json_truncated"]
    return judged.withColumns(fields)


def key_frequency(df: DataFrame, content: str = "content") -> DataFrame:
    """How many texts have each root key."""
    valid = df.where(jt.is_valid_json(F.col(content)))
    return (
        valid.select(F.explode(jt.root_keys(F.col(content))).alias("key"))
        .groupBy("key")
        .agg(F.count("*").alias("n"))
    )


YAML_TYPE = (
    "struct<yaml_valid boolean, yaml_error string, "
    "yaml_structure struct<type string, key_count bigint, sample_keys array<string>, "
    "length bigint, sample_item_types array<string>>, "
    "yaml_root_keys array<string>, yaml_root_key_count bigint, yaml_depth bigint, "
    "yaml_size bigint, content_preview string, error string>"
)


def _yaml_kind(value) -> str:
    if value is None:
        return "null"
    # bool before int: a flag is not a number here.
    for types, name in (
        (dict, "mapping"), (list, "sequence"), (str, "string"),
        (bool, "boolean"), ((int, float), "number"),
    ):
        if isinstance(value, types):
            return name
    return type(value).__name__


def _yaml_depth(root) -> int:
    """Longest chain of non-empty containers. Levels are walked with a stack, and an
    anchor that several places share is entered once per level at most."""
    deepest, stack, seen = 0, [(root, 0)], set()
    while stack:
        value, level = stack.pop()
        deepest = max(deepest, level)
        if isinstance(value, (dict, list)):
            if (id(value), level) in seen:
                continue
            seen.add((id(value), level))
            if level > 10_000:
                raise RecursionError("document refers to itself")
            children = value.values() if isinstance(value, dict) else value
            stack.extend((child, level + 1) for child in children)
    return deepest


def _yaml_record(text: str) -> dict:
    """One text to one record; Spark has no YAML function, so a safe loader reads it."""
    try:
        import yaml
    except ImportError:
        return {"error": "YAML library not available"}
    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    try:
        value = yaml.load(text, Loader=loader)  # noqa: S506 - a safe loader
        kind = _yaml_kind(value)
        keys = [str(k) for k in value] if kind == "mapping" else []
        shape = {"type": kind}
        if kind == "mapping":
            shape.update(key_count=len(keys), sample_keys=keys)
        elif kind == "sequence":
            shape.update(
                length=len(value),
                sample_item_types=sorted({_yaml_kind(v) for v in value}),
            )
        elif kind == "string":
            shape.update(length=len(value))
        return {
            "yaml_valid": True,
            "yaml_structure": shape,
            "yaml_root_keys": keys,
            "yaml_root_key_count": len(keys),
            "yaml_depth": _yaml_depth(value),
            "yaml_size": len(text),
            "content_preview": text[:PREVIEW_CHARS],
        }
    except yaml.YAMLError as problem:
        return {"yaml_valid": False, "yaml_error": str(problem), "error": str(problem)}
    except Exception as problem:  # a value the loader accepts but cannot build
        return {"error": f"{type(problem).__name__}: {problem}"}


def yaml_struct(content: Column) -> Column:
    """All YAML fields as one struct; null content stays null."""
    return map_texts(content, _yaml_record, YAML_TYPE)


def yaml_profile(df: DataFrame, content: str = "content") -> DataFrame:
    """Add the YAML fields: validity, structure, root keys, depth and size."""
    names = [
        "yaml_valid", "yaml_error", "yaml_structure", "yaml_root_keys",
        "yaml_root_key_count", "yaml_depth", "yaml_size",
    ]
    profiled = df.withColumn("__yaml", yaml_struct(F.col(content)))
    return profiled.withColumns({n: F.col(f"__yaml.{n}") for n in names}).drop("__yaml")
