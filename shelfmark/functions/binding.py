"""Evaluate an expensive column once and use it several times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A lambda variable holds the result, so the optimizer cannot inline the
    expression into every use (which matters inside higher-order functions).
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
