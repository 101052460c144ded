"""Exact medians of very large groups without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The sketch is off by at most one part in ACCURACY of the ranks; the bracket is twice
# as wide on either side, so it holds four parts in ACCURACY of the values (and whatever
# equals them). It is cut into SLICES, of which only those with the median are ordered.
ACCURACY = 1_000
MARGIN = 2.0 / ACCURACY
SLICES = 256


def bracket(value: Column) -> Column:
    """Aggregate: two values between which the median lies, in bounded memory."""
    return F.percentile_approx(value, [0.5 - MARGIN, 0.5 + MARGIN], ACCURACY)


def exact_medians(
    values: DataFrame, brackets: DataFrame, keys: Sequence[str], value: str
) -> DataFrame:
    """``keys, median`` from the values and ``keys, ends, n`` computed over the same values.

    The keys are few (columns of a schema), the values per key any number. A second pass
    counts what lies below the bracket and, per distinct value, what lies inside; both
    are combined on the map side, so a value that fills a third of a column is one row
    per task. The counts of the slices tell which slice holds the median, and only the
    distinct values of that slice are put in order. A rank that the sketch failed to
    bracket stops the query rather than giving a wrong median.
    """
    keys = list(keys)
    v = F.col(value)
    joined = values.where(v.isNotNull()).join(brackets, keys)
    low, high = F.get("ends", F.lit(0)), F.get("ends", F.lit(1))
    share = F.try_divide(v - low, high - low)
    # Slice 0 counts everything below the bracket; any monotone slicing will do.
    part = F.when(v < low, 0).otherwise(
        1 + F.coalesce(F.least(F.floor(share * SLICES), F.lit(SLICES - 1)), F.lit(0))
    )
    counted = (
        joined.where(v <= high)
        .select(*keys, "n", part.cast("int").alias("part"), F.when(v >= low, v).alias("at"))
        .groupBy(*keys, "n", "part", "at")
        .agg(F.count("*").alias("here"))
    )
    left, right = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1

    # At most SLICES + 1 rows per key; one or two of them are kept.
    totals = counted.groupBy(*keys, "n", "part").agg(F.sum("here").alias("total"))
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    started = totals.withColumn("before", F.coalesce(F.sum("total").over(earlier), F.lit(0)))
    wanted = started.where(
        (F.col("before") < right) & (F.col("before") + F.col("total") >= left)
    ).select(*keys, "part", "before")

    order = Window.partitionBy(*keys, "part").orderBy("at")
    upto = F.col("before") + F.sum("here").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.join(F.broadcast(wanted), [*keys, "part"]).withColumn("upto", upto)

    def value_at(rank: Column) -> Column:
        covered = (rank > F.col("upto") - F.col("here")) & (rank <= F.col("upto"))
        return F.max(F.when(covered, F.col("at")))

    both = ranked.groupBy(*keys).agg(value_at(left).alias("a"), value_at(right).alias("b"))
    middle = (F.col("a") + F.col("b")) / 2
    return both.select(
        *keys,
        F.when(middle.isNull(), F.raise_error(F.lit("median not bracketed")).cast("double"))
        .otherwise(middle)
        .alias("median"),
    )
