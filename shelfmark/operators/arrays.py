"""Numeric arrays and trees of named items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays as af

# Bytes per element.
ELEMENT_WIDTH = {
    "boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8,
}


def array_statistics(
    df: DataFrame, column: str, max_len: int | None = None
) -> DataFrame:
    """Add ``min``, ``max``, ``mean`` and population ``std`` of an array column."""
    stats = df.withColumn("__stats", af.array_statistics(F.col(column), max_len))
    return stats.withColumns(
        {n: F.col(f"__stats.{n}") for n in ("min", "max", "mean", "std")}
    ).drop("__stats")


def array_layout(df: DataFrame, column: str) -> DataFrame:
    """Add ``n_elements``, ``shape`` text, ``dtype`` and ``size_bytes``."""
    kind = df.schema[column].dataType
    if not isinstance(kind, T.ArrayType):
        raise TypeError(f"{column!r} is not an array column")
    dtype = kind.elementType.simpleString()
    width = ELEMENT_WIDTH.get(dtype)
    if width is None:
        raise TypeError(f"elements of type {dtype} have no fixed width")
    # A missing array has no size (and not the -1 that size() may give).
    n = F.when(F.col(column).isNotNull(), F.size(column)).cast("long")
    return df.withColumns(
        {
            "n_elements": n,
            "shape": F.concat(F.lit("("), n.cast("string"), F.lit(",)")),
            "dtype": F.lit(dtype),
            "size_bytes": n * width,
        }
    )


def dataset_totals(df: DataFrame, container: str, size_bytes: str = "size_bytes") -> DataFrame:
    """Number of datasets and their total size per container."""
    return df.groupBy(container).agg(
        F.count("*").alias("total_datasets"), F.sum(size_bytes).alias("total_size_bytes")
    )


def list_hierarchy(
    items: DataFrame,
    max_depth: int | None = None,
    per_group: int | None = None,
    path: str = "path",
) -> DataFrame:
    """Groups and leaves of a tree of ``/``-separated paths.

    One row per listed item: ``item, parent, type, depth, num_items``. All are listed by
    default; ``max_depth`` leaves out what lies deeper and ``per_group`` lists that many
    leaves of a group, in name order (its groups all the same); ``num_items`` counts all
    children of a group. Leaves shrink to one row per directory before directories are
    expanded into their ancestors, and the per-group cap is applied before the shuffle.
    """
    parts = F.split(F.regexp_replace(F.col(path), "^/+", ""), "/", -1)
    leaves = items.select(
        F.regexp_replace(F.col(path), "^/+", "").alias("item"),
        (F.size(parts) - 1).alias("depth"),
    ).withColumn(
        "parent", F.regexp_extract("item", r"^(.*)/[^/]*$", 1)
    )

    # Leaves, at most ``per_group`` of each parent.
    by_name = Window.partitionBy("parent").orderBy("item")
    listed = leaves if max_depth is None else leaves.where(F.col("depth") <= max_depth)
    if per_group is not None:
        listed = listed.withColumn("__rank", F.row_number().over(by_name)).where(
            F.col("__rank") <= per_group
        )
    listed = listed.select(
        "item", "parent", F.lit("dataset").alias("type"), F.col("depth").cast("long"),
        F.lit(None).cast("long").alias("num_items"),
    )

    # Directories with the number of leaves directly in them; their ancestors have none.
    own = leaves.groupBy("parent").agg(F.count("*").alias("n_leaves"))
    steps = F.split("parent", "/", -1)
    prefix = lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/")
    deepest = F.size(steps) if max_depth is None else F.least(F.size(steps), F.lit(max_depth + 2))
    spread = own.where(F.col("parent") != "").select(
        F.explode(
            F.transform(
                F.sequence(F.lit(1), deepest),
                lambda i: F.struct(
                    prefix(i).alias("item"),
                    F.when(i == F.size(steps), F.col("n_leaves")).otherwise(0).alias("n_leaves"),
                ),
            )
        ).alias("g")
    )
    groups = (
        spread.groupBy("g.item")
        .agg(F.sum("g.n_leaves").alias("n_leaves"))
        .withColumn("parent", F.regexp_extract("item", r"^(.*)/[^/]*$", 1))
    )
    # A directory is one child of its parent: sum children and leaves per item at once.
    counted = (
        groups.select("item", F.lit(True).alias("is_group"), F.col("n_leaves").alias("n"))
        .unionByName(
            groups.where(F.col("parent") != "").select(
                F.col("parent").alias("item"), F.lit(False).alias("is_group"), F.lit(1).alias("n")
            )
        )
        .groupBy("item")
        .agg(F.sum("n").alias("num_items"))
    )
    depth = (F.size(F.split("item", "/", -1)) - 1).cast("long")
    listed_groups = counted.select(
        "item",
        F.regexp_extract("item", r"^(.*)/[^/]*$", 1).alias("parent"),
        F.lit("group").alias("type"),
        depth.alias("depth"),
        "num_items",
    )
    if max_depth is not None:
        listed_groups = listed_groups.where(F.col("depth") <= max_depth)
    return listed_groups.unionByName(listed)
