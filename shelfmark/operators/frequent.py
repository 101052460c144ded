"""The most frequent of very many values, exactly, without shuffling a row for each value.

A frequent-items sketch names candidates. One pass counts these exactly and everything else by
hashed cell: the count of the last candidate that would be shown is a proven lower bound, and a
cell that stays below it holds no value that could be shown. Only values of the cells that are
left are counted by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRACKED = 4_000  # values that a sketch tracks at least
CELLS_BROADCAST = 1_000_000  # facets x cells that are broadcast at most


def candidates(long: DataFrame, size: int) -> DataFrame:
    """``facet, value``: at most ``2 * size`` likely values of each facet."""
    k = 2 * size
    top = F.expr(f"approx_top_k(value, {k}, {max(TRACKED, 2 * k)})")
    listed = long.groupBy("facet").agg(top.alias("top"))
    return listed.select("facet", F.explode("top").alias("top")).select("facet", F.col("top.item").alias("value"))


def top_counts(long: DataFrame, size: int, cells: int, facets: int) -> DataFrame:
    """``facet, value, n``: all values that can be among the ``size`` most frequent of a facet.

    ``long`` has ``facet, value`` as texts without nulls and must give the same rows each time;
    it is read three times, the first time when the plan is built. The first passes shuffle at most a sketch a task and facet, and a row a
    task, facet and cell or candidate. Ties with the bound are kept. Where a facet has fewer
    values than ``size`` or all are about equally frequent, every cell is left and all values
    are counted.
    """
    # The sketch may differ from run to run, so its candidates, at most 2 * size of a facet, are
    # fetched once: all passes must agree on which values are counted by name.
    named_values = [(r["facet"], r["value"], True) for r in candidates(long, size).collect()]
    likely = F.broadcast(long.sparkSession.createDataFrame(named_values, "facet string, value string, __likely boolean"))
    cell = F.pmod(F.xxhash64("facet", "value"), F.lit(cells)).alias("__cell")
    marked = long.join(likely, ["facet", "value"], "left").select(
        "facet", "value", cell, F.coalesce("__likely", F.lit(False)).alias("__likely")
    )
    named = F.when(F.col("__likely"), F.col("value"))
    counts = marked.groupBy("facet", "__likely", F.when(~F.col("__likely"), F.col("__cell")).alias("__cell"),
                            named.alias("value")).agg(F.count("*").alias("n"))
    counted = counts.where("__likely").select("facet", "value", "n")
    by_count = Window.partitionBy("facet").orderBy(F.desc("n"), "value")
    bound = counted.withColumn("__rank", F.row_number().over(by_count)).where(F.col("__rank") == size)
    bound = bound.select("facet", F.col("n").alias("__least"))
    left = counts.where("NOT __likely").join(F.broadcast(bound), "facet", "left")
    left = left.where(F.col("n") >= F.coalesce("__least", F.lit(0))).select("facet", "__cell")
    if facets * cells <= CELLS_BROADCAST:
        left = F.broadcast(left)
    rest = marked.where("NOT __likely").join(left, ["facet", "__cell"], "left_semi")
    return counted.unionByName(rest.groupBy("facet", "value").agg(F.count("*").alias("n")))
