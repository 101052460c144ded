"""Connected components by alternating star contractions, on DataFrames of links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut

BROADCAST_ROWS = 500_000  # rows of a few numbers that may be broadcast; counted before
TASK_ROWS = 250_000  # rows of a few numbers that one task is given at least


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """A checkpoint of the table, and its rows."""
    df = cut(df)
    return df, df.count()


def light(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table of so many rows if that is few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def packed(df: DataFrame, rows: int, each: int = TASK_ROWS) -> DataFrame:
    """Fewer tasks for a table of at most so many rows; rows of one partition stay together."""
    return df.coalesce(rows // each + 1) if rows <= 100 * each else df


@dataclass
class Roots:
    """(_key, _root) of all keys that are not the smallest of their component."""

    table: DataFrame
    rows: int


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def component_roots(links: DataFrame, rows: int) -> Roots:
    """Roots of ``links`` (a, b), of which there are ``rows``.

    Each round links every key's larger neighbours to its smallest one, then every key to the
    smallest of its smaller neighbours; it ends when all links are (key, smallest). Rounds
    grow with the logarithm of the longest chain; only a count and a checksum reach the
    driver, and each round is checkpointed.
    """
    edges = cut(
        packed(
            links.filter(F.col("a") != F.col("b"))
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            .distinct(),
            rows,
        )
    )
    before = None
    while (now := _state(edges)) != before:
        before, n = now, now[0]
        if not n:
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = packed(both.groupBy("a").agg(F.min("b").alias("_m")), n).withColumn("_m", F.least("a", "_m"))
        large = (
            both.join(light(least, n), "a").filter(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("_m").alias("b")).filter(F.col("a") != F.col("b"))
        )
        least = packed(large.groupBy("a").agg(F.min("b").alias("_m")), n)
        small = large.join(light(least, n), "a").select(
            F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("_m").alias("y")),
                              F.struct(F.col("b").alias("x"), F.col("_m").alias("y")))).alias("e")
        )
        pairs = small.select(F.col("e.x").alias("a"), F.col("e.y").alias("b")).filter(F.col("a") != F.col("b"))
        edges = cut(packed(pairs.distinct(), n))
    return Roots(edges.select(F.col("a").alias("_key"), F.col("b").alias("_root")), before[0] if before else 0)


def merge_roots(roots: Roots | None, links: DataFrame) -> Roots | None:
    """The roots after further links."""
    new, rows = counted(links.select("a", "b"))
    if not rows:
        return roots
    if roots is None:
        return component_roots(new, rows)
    old = roots.table.select(F.col("_key").alias("a"), F.col("_root").alias("b"))
    return component_roots(new.union(old), rows + roots.rows)


def with_root(df: DataFrame, roots: Roots | None, key: str, name: str) -> DataFrame:
    """Add each key's component; a key without links is its own."""
    if roots is None:
        return df.withColumn(name, F.col(key))
    named = roots.table.select(F.col("_key").alias(key), F.col("_root").alias(name))
    return df.join(light(named, roots.rows), key, "left").withColumn(name, F.coalesce(name, key))
