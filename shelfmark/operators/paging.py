"""One page of an ordered result at any depth, without sorting the whole table.

A sample of the sort keys gives borders near the page, one pass counts the rows before each
border, and only the rows between the two borders around the page are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

SHALLOW_ROWS = 2_000  # a page that ends by this row is a distributed top-k
SAMPLE_ROWS = 2_000  # sort keys that the driver sees, as a mean
BORDERS = 32
REACH = 96  # sample rows on either side of the page's place; over four deviations at its middle


def _before(keys: Sequence[tuple[str, bool]], border: Row) -> Column:
    """Whether a row comes before a border, nulls where Spark sorts them: first going up,
    last going down."""
    found, equal = [], F.lit(True)
    for i, (name, down) in enumerate(keys):
        column, value = F.col(name), F.lit(border[i])
        if border[i] is None:
            ahead = column.isNotNull() if down else F.lit(False)
        else:
            ahead = F.coalesce(column > value, F.lit(False)) if down else column.isNull() | (column < value)
        found.append(equal & ahead)
        equal = equal & column.eqNullSafe(value.cast("string") if border[i] is None else value)
    return reduce(lambda a, b: a | b, found)


def sort_columns(keys: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(name).desc() if down else F.col(name).asc() for name, down in keys]


def select_range(
    df: DataFrame, keys: Sequence[tuple[str, bool]], first: int, last: int, seed: int = 11
) -> tuple[DataFrame, int]:
    """The rows of a narrow range that holds the ordered rows ``first`` to ``last`` (from 0,
    ``last`` excluded), and how many rows come before the range.

    Reads the table three times (count, sample, counts per border) and shuffles only partial
    counts and the sample. Whatever the sample is, the range holds the rows asked for; a poor
    sample only makes it wider. ``df`` must give the same rows each time.
    """
    names = [F.col(name).alias(f"k{i}") for i, (name, _) in enumerate(keys)]
    total = df.count()
    if first >= total:
        return df.limit(0), 0
    drawn = df.select(*names).where(F.rand(seed) < min(1.0, SAMPLE_ROWS / total))
    sample = sorted_rows(drawn, keys)
    middle = len(sample) * (first + last) // (2 * total)
    lowest, highest = max(0, middle - REACH), min(len(sample) - 1, middle + REACH)
    step = max(1, (highest - lowest) // BORDERS)
    borders = sample[lowest : highest + 1 : step]
    if not borders:
        return df, 0
    counted = df.agg(*[F.count_if(_before(keys, b)).alias(f"b{i}") for i, b in enumerate(borders)]).first()
    under = [i for i in range(len(borders)) if counted[i] <= first]
    over = [i for i in range(len(borders)) if counted[i] >= last]
    if over:
        df = df.where(_before(keys, borders[over[0]]))
    if under:
        df = df.where(~_before(keys, borders[under[-1]]))
    return df, counted[under[-1]] if under else 0


def sorted_rows(drawn: DataFrame, keys: Sequence[tuple[str, bool]]) -> list[Row]:
    """The sampled keys in order; a mean of ``SAMPLE_ROWS`` rows comes to the driver."""
    return drawn.orderBy(*sort_columns([(f"k{i}", down) for i, (_, down) in enumerate(keys)])).collect()


def deep_page(df: DataFrame, keys: Sequence[tuple[str, bool]], n: int, page: int) -> DataFrame:
    """One page by range selection: only the range that holds it is sorted."""
    first = (page - 1) * n
    part, skipped = select_range(df, keys, first, first + n)
    return part.orderBy(*sort_columns(keys)).offset(first - skipped).limit(n)
