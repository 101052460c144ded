"""Value distributions per group: dominant values and average colours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import DOMINANT_VALUES
from ..functions import images


def dominant_values(
    df: DataFrame, group: str, value: str | Sequence[str], k: int = DOMINANT_VALUES
) -> DataFrame:
    """The ``k`` most frequent values of each group with their share in percent.

    Values are counted on the map side first. The cut to ``k`` happens before the
    counts are shuffled by group, and the totals are a second small aggregation of the
    same counts, so a group of any size stays spread over tasks.
    """
    columns = [value] if isinstance(value, str) else list(value)
    counts = df.groupBy(group, *columns).agg(F.count("*").alias("n"))
    order = Window.partitionBy(group).orderBy(F.desc("n"), *columns)
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    totals = counts.groupBy(F.col(group).alias("__group")).agg(F.sum("n").alias("__total"))
    return top.join(totals, F.col(group).eqNullSafe(F.col("__group"))).select(
        group,
        *columns,
        "n",
        F.bround(F.col("n") / F.col("__total") * 100, 2).alias("percentage"),
        "rank",
    )


def average_color(
    pixels: DataFrame, group: str, r: str = "r", g: str = "g", b: str = "b"
) -> DataFrame:
    """Rounded channel means per group with hex form and brightness."""
    means = pixels.groupBy(group).agg(
        *[F.bround(F.avg(c), 0).cast("int").alias(n) for c, n in ((r, "r"), (g, "g"), (b, "b"))]
    )
    return means.withColumns(
        {
            "hex": images.hex_color(F.col("r"), F.col("g"), F.col("b")),
            "brightness": images.brightness(F.col("r"), F.col("g"), F.col("b")),
        }
    )


def image_geometry(df: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """Add ``aspect_ratio`` and ``pixel_count``."""
    return df.withColumns(
        {
            "aspect_ratio": images.aspect_ratio(F.col(width), F.col(height)),
            "pixel_count": images.pixel_count(F.col(width), F.col(height)),
        }
    )
