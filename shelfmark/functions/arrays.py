"""Columns over numeric arrays and attribute maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import ATTRIBUTES_PER_ITEM
from .binding import let


def array_statistics(values: Column, max_len: int | None = None) -> Column:
    """min, max, mean and population standard deviation of a numeric array.

    Null for empty arrays and, where it is given, for arrays of ``max_len`` elements or more.
    """
    doubles = F.transform(values, lambda x: x.cast("double"))
    add = lambda acc, x: acc + x

    def spread(a: Column) -> Column:
        mean = F.aggregate(a, F.lit(0.0), add) / F.size(a)
        return let(
            mean,
            lambda m: F.struct(
                F.array_min(a).alias("min"),
                F.array_max(a).alias("max"),
                m.alias("mean"),
                F.sqrt(
                    F.aggregate(a, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m)) / F.size(a)
                ).alias("std"),
            ),
        )

    size = F.size(values)
    wanted = size > 0 if max_len is None else (size > 0) & (size < max_len)
    return F.when(wanted, let(doubles, spread))


def limit_attributes(attributes: Column, n: int = ATTRIBUTES_PER_ITEM) -> Column:
    """The first ``n`` entries of a map."""
    return F.map_from_entries(F.slice(F.map_entries(attributes), 1, n))
