"""Frequent values by sketch, bound and cells, against plain counts."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import shelfmark as sm
from shelfmark.operators import frequent


def plain(pairs, size):
    counts = {}
    for facet, value in pairs:
        if value is not None:
            counts.setdefault(facet, Counter())[value] += 1
    return {(f, v, n) for f, c in counts.items() for v, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:size]}


@pytest.mark.parametrize("cells,bound", [(1, 1_000_000), (64, 1_000_000), (4096, 0)])
def test_equal_to_plain_counts(spark, monkeypatch, cells, bound):
    monkeypatch.setattr(frequent, "CELLS_BROADCAST", bound)
    monkeypatch.setattr(frequent, "TRACKED", 16)  # too few to hold all: the cells must find the rest
    # Field a falls slowly, b is flat, c is a third one value, d has three values, e is null.
    df = spark.range(6_000).select(
        F.floor(F.sqrt("id")).cast("string").alias("a"),
        F.col("id").cast("string").alias("b"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 700).cast("string")).alias("c"),
        F.when(F.col("id") % 4 > 0, (F.col("id") % 4).cast("string")).alias("d"),
        F.lit(None).cast("string").alias("e"),
    )
    pairs = [(c, r[c]) for r in df.collect() for c in df.columns]
    got = [tuple(r) for r in sm.term_facets(df, df.columns, size=5, cells=cells).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(pairs, 5)


def test_cells_below_the_bound_are_not_counted_by_value(spark):
    df = spark.range(200_000).select(
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("h"), (F.floor(F.col("id") / 10) % 5).cast("string"))).otherwise(F.col("id").cast("string")).alias("v")
    )
    long = df.select(F.lit("v").alias("facet"), F.col("v").alias("value"))
    counted = frequent.top_counts(long, 5, 4096, 1)
    assert counted.count() < 100  # of 180,005 values
    assert {r["value"] for r in sm.term_facets(df, ["v"], size=5, cells=4096).collect()} == {f"h{i}" for i in range(5)}


def test_empty_and_wrong(spark):
    empty = spark.createDataFrame([], "v string, w array<string>")
    assert sm.term_facets(empty, ["v", "w"], cells=8).count() == 0
    with pytest.raises(ValueError):
        sm.term_facets(empty, ["v"], size=0)
