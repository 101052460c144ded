"""Look up, filter, facet and page the entries or the catalog."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import FACET_SIZE, PUBLIC, RESULTS_PER_PAGE
from . import frequent, paging


def get_entry(entries: DataFrame, subject: str) -> DataFrame:
    """The entry of a subject, or no row."""
    return entries.where(F.col("subject") == subject)


def visible_entries(entries: DataFrame, principals: Sequence[str] = ()) -> DataFrame:
    """Entries that are public or shared with one of the principals."""
    allowed = F.array(*[F.lit(p) for p in [PUBLIC, *principals]])
    return entries.where(F.arrays_overlap("visible_to", allowed))


def _field_type(schema: T.StructType, field: str) -> T.DataType:
    kind: T.DataType = schema
    for part in field.split("."):
        kind = kind[part].dataType
    return kind


def term_facets(
    df: DataFrame, fields: Sequence[str] | Mapping[str, str], size: int = FACET_SIZE, cells: int | None = None
) -> DataFrame:
    """``facet, value, n``: the most frequent values of each field, all in one pass.

    ``fields`` are column paths, or a mapping of facet names to them. Array fields count
    every element. Missing values are no facet values. Counting combines on the map side
    and the cut to ``size`` is made before the counts are gathered per facet. With ``cells``,
    for fields of very many values, the same result takes three passes and shuffles counts of
    hashed cells in place of a row for each value and task (see ``frequent.top_counts``).
    """
    if size < 1 or (cells is not None and cells < 1):
        raise ValueError("size and cells start at 1")
    named = dict(fields) if isinstance(fields, Mapping) else {f: f for f in fields}
    pairs = []
    for name, field in named.items():
        column = F.col(field)
        if isinstance(_field_type(df.schema, field), T.ArrayType):
            values = F.coalesce(
                F.transform(F.array_distinct(column), lambda v: v.cast("string")),
                F.array().cast("array<string>"),
            )
        else:
            values = F.array(column.cast("string"))
        pairs.append(_tag(values, name))
    long = df.select(F.inline(F.concat(*pairs))).where(F.col("value").isNotNull())
    if cells is None:
        counts = long.groupBy("facet", "value").agg(F.count("*").alias("n"))
    else:
        counts = frequent.top_counts(long, size, cells, len(named))
    order = Window.partitionBy("facet").orderBy(F.desc("n"), "value")
    ranked = counts.withColumn("__rank", F.row_number().over(order))
    return ranked.where(F.col("__rank") <= size).select("facet", "value", "n")


def _tag(values: Column, name: str) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(name).alias("facet"), v.alias("value")))


def filter_terms(df: DataFrame, field: str, values: Sequence[str]) -> DataFrame:
    """Multi-select filter: the field is one of the values (or, for an array field, has one)."""
    if not values:
        return df
    if isinstance(_field_type(df.schema, field), T.ArrayType):
        return df.where(F.arrays_overlap(field, F.array(*[F.lit(v) for v in values])))
    return df.where(F.col(field).isin(list(values)))


def filter_date_range(
    df: DataFrame, field: str, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Keep rows whose date field lies between the bounds, both included."""
    tests = []
    if start is not None:
        tests.append(F.col(field) >= F.lit(start).cast("timestamp"))
    if end is not None:
        tests.append(F.col(field) <= F.lit(end).cast("timestamp"))
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def page_results(
    df: DataFrame,
    order_by: Sequence[str | tuple[str, str] | Column],
    n: int = RESULTS_PER_PAGE,
    page: int = 1,
) -> DataFrame:
    """One page of results (from 1); ``order_by`` must be a total order.

    Keys are names, or names with ``"asc"`` or ``"desc"``; nulls come first going up and last
    going down. Pages near the front are a distributed top-k. A deeper page is found by
    counting rows between sampled borders, and only the range that holds it is sorted; the
    counts run when the plan is built. Keys given as columns are sorted whole at any depth.
    """
    if page < 1 or n < 1:
        raise ValueError("page and n start at 1")
    keys = [(k, "asc") if isinstance(k, str) else k for k in order_by]
    named = all(isinstance(k, tuple) for k in keys)
    if any(isinstance(k, tuple) and k[1] not in ("asc", "desc") for k in keys):
        raise ValueError("a key is sorted asc or desc")
    if named and page > 1 and page * n > paging.SHALLOW_ROWS:
        return paging.deep_page(df, [(name, way == "desc") for name, way in keys], n, page)
    ordered = df.orderBy(*[paging.sort_columns([(k[0], k[1] == "desc")])[0] if isinstance(k, tuple) else k for k in keys])
    return (ordered.offset((page - 1) * n) if page > 1 else ordered).limit(n)


def result_view(catalog: DataFrame) -> DataFrame:
    """The result list: heading and the eight shown fields (missing ones are null)."""
    wanted = {
        "heading": "file.filename",
        "directory": "file.directory",
        "size": "file.size_bytes",
        "extension": "file.extension",
        "language": "language",
        "line_count": "line_count",
        "complexity": "complexity",
        "imports": "imports",
        "content_preview": "content_preview",
    }
    return catalog.select(
        *[
            (F.col(source) if source.split(".")[0] in catalog.columns else F.lit(None).cast("string"))
            .alias(name)
            for name, source in wanted.items()
        ]
    )


def human_size(size: Column) -> Column:
    """Bytes with a binary unit and one decimal from 1,024 bytes on."""
    text = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB", "PB"), start=1):
        scaled = size / F.lit(float(1024**power))
        text = F.when(
            size >= 1024**power, F.concat(F.format_string("%.1f", scaled), F.lit(f" {unit}"))
        ).otherwise(text)
    return text


def detail_view(catalog: DataFrame) -> DataFrame:
    """The detail page: title, description, keywords, type, human size and dates."""
    columns = set(catalog.columns)

    def column(name: str, kind: str) -> Column:
        return F.col(name) if name in columns else F.lit(None).cast(kind)

    def day(name: str) -> Column:
        return F.date_format(column(name, "timestamp"), "yyyy-MM-dd")

    return catalog.select(
        F.coalesce(column("title", "string"), F.col("file.filename")).alias("title"),
        F.coalesce(column("description", "string"), column("content_preview", "string")).alias(
            "description"
        ),
        column("keywords", "array<string>").alias("keywords"),
        F.coalesce(column("file_type", "string"), column("mime_type", "string")).alias("file_type"),
        human_size(F.col("file.size_bytes")).alias("size"),
        day("created_at").alias("created"),
        day("modified_at").alias("modified"),
    )
