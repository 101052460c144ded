"""Pages at any depth, against the sorted list."""

import random

import pytest
from pyspark.sql import functions as F

import shelfmark as sm
from shelfmark.operators import paging


def ordered(rows, ways):
    """Nulls first going up and last going down, NaN above all numbers, as Spark sorts."""
    for at in reversed(range(len(ways))):
        rank = lambda r: (0,) if r[at] is None else (2,) if r[at] != r[at] else (1, r[at])  # noqa: E731, B023
        rows = sorted(rows, key=rank, reverse=ways[at] == "desc")
    return rows


@pytest.mark.parametrize("ways", [("asc", "desc", "asc"), ("desc", "asc", "desc")])
def test_every_page_of_a_skewed_order(spark, monkeypatch, ways):
    monkeypatch.setattr(paging, "SHALLOW_ROWS", 0)
    monkeypatch.setattr(paging, "SAMPLE_ROWS", 150)
    monkeypatch.setattr(paging, "REACH", 12)
    rng = random.Random(3)
    # A third of the rows share one value; nulls and NaN lie at the ends.
    rows = [(rng.choice([7.0, None, float("nan"), rng.random() * 9]) if i % 3 else 7.0, rng.choice(["a", None, "é", "b"]), i)
            for i in range(900)]
    df = spark.createDataFrame(rows, "a double, b string, id int").repartition(5)
    keys = list(zip(["a", "b", "id"], ways))
    want = [r[2] for r in ordered(rows, ways)]
    for page in (2, 3, 5, 8, 9, 10):
        got = [r["id"] for r in sm.page_results(df, keys, 100, page).collect()]
        assert got == want[(page - 1) * 100 : page * 100]


def test_only_a_range_is_sorted(spark):
    df = spark.range(200_000).select(F.xxhash64("id").alias("h"), "id")
    keys = [("h", False), ("id", False)]
    part, skipped = paging.select_range(df, keys, 120_000, 120_020)
    n = part.count()
    assert 20 <= n < 10_000 and skipped <= 120_000 < 120_020 <= skipped + n
    want = [r["id"] for r in df.orderBy("h", "id").offset(120_000).limit(20).collect()]
    assert [r["id"] for r in sm.page_results(df, ["h", "id"], 20, 6001).collect()] == want


def test_equal_rows_empty_tables_and_wrong_keys(spark, monkeypatch):
    monkeypatch.setattr(paging, "SHALLOW_ROWS", 0)
    same = spark.range(300).select(F.lit("x").alias("k"))
    assert sm.page_results(same, ["k"], 40, 8).count() == 20
    assert sm.page_results(same, ["k"], 40, 9).count() == 0
    assert sm.page_results(same.limit(0), ["k"], 40, 2).count() == 0
    with pytest.raises(ValueError):
        sm.page_results(same, [("k", "down")], 40, 2)
