import math

import numpy as np
import pytest

from shelfmark.llm import nearest
from shelfmark.llm.nearest import Codes, nearest_by_product, rotation

KIND = "vec_id long, embedding array<float>, label int, rank int"


def brute(rows, queries, k):
    ok = lambda v: v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)
    rows = [(i, v) for i, v in rows if i is not None and ok(v)]
    out = []
    for q, v in [(i, v) for i, v in rows if i in queries]:
        found = []
        for i, w in rows:
            if i != q and len(w) == len(v):
                total = 0.0
                for a, b in zip(v, w):
                    total += float(np.float32(a)) * float(np.float32(b))
                found.append((-total, i))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def run(spark, rows, queries, **how):
    df = spark.createDataFrame([(i, v, 0, 9) for i, v in rows], KIND)
    found = nearest_by_product(df, df.filter(df.vec_id.isin(list(queries))), **how)
    return sorted(map(tuple, found.collect()))


def test_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(30)]
    rows += [(40, None), (41, [0.0] * 8), (42, [1.0] * 7 + [float("nan")]), (43, [1.0] * 7 + [None]),
             (44, [float("inf")] + [1.0] * 7), (45, []), (None, [1.0] * 8), (46, [1.0, 2.0]), (47, [3.0, 1.0])]
    rows += [(50, rows[3][1]), (51, rows[3][1])]  # ties
    queries = {0, 3, 40, 41, 46, 50}
    assert run(spark, rows, queries, k=20) == brute(rows, queries, 20)


@pytest.mark.parametrize("dimensions", [3, 64, 100])
def test_many_blocks_find_the_exact_neighbours(spark, monkeypatch, dimensions):
    monkeypatch.setattr(nearest, "DATA_BLOCK", 300)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 40)
    rng = np.random.default_rng(dimensions)
    centres = rng.normal(size=(10, dimensions)) * 2
    rows = [(i, (centres[i % 10] + rng.normal(size=dimensions)).astype(np.float32).tolist()) for i in range(1200)]
    queries = set(range(0, 1200, 20))
    got, want = run(spark, rows, queries, k=10), brute(rows, queries, 10)
    assert got == want


def test_fewer_candidates_than_asked_and_none(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.5, 1.0])]
    assert run(spark, rows, {1}, k=20) == [(1, 1, 2, 0.5), (1, 2, 2, 0.0)]
    assert run(spark, [(1, [1.0, 2.0])], {1}) == []
    empty = spark.createDataFrame([], KIND)
    assert nearest_by_product(empty, empty).count() == 0


def test_estimates_stay_within_their_bounds():
    rng = np.random.default_rng(3)
    vectors, queries = rng.normal(size=(2000, 64)) + 1, rng.normal(size=(50, 64))
    centre, turn = vectors.mean(axis=0), rotation(64, 256, 1)
    codes = Codes.of(vectors, centre, turn)
    estimate, unit = codes.estimates(queries, centre, turn)
    off = (estimate - queries @ vectors.T) / unit
    assert (np.abs(off) > 4).mean() < 1e-3
    assert abs(off.mean()) < 0.05 and 0.5 < off.std() < 1.5
    assert codes.words.nbytes == 2000 * 32


def test_bit_counts_give_the_product_with_the_signs():
    rng = np.random.default_rng(5)
    vectors, queries = rng.normal(size=(300, 25)), rng.normal(size=(20, 25))
    centre, turn = vectors.mean(axis=0), rotation(25, 100, 2)
    codes = Codes.of(vectors, centre, turn)
    signs = np.where((vectors - centre) @ turn > 0, 1.0, -1.0)
    turned = queries @ turn
    low, step = turned.min(axis=1, keepdims=True), np.ptp(turned, axis=1, keepdims=True) / (2**nearest.PLANES - 1)
    cut = low + step * np.rint((turned - low) / step)
    want = cut @ signs.T * codes.scale + (queries @ centre)[:, None]
    estimate, _ = codes.estimates(queries, centre, turn)
    assert np.allclose(estimate, want, atol=1e-4)


def test_floats_and_doubles_are_not_rounded(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(40)]
    wide = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest_by_product(wide, wide.filter("vec_id % 20 = 0"), k=3)
    for q, n, i, score in map(tuple, got.collect()):
        total = 0.0  # sum() would compensate for rounding
        for a, b in zip(rows[q][1], rows[i][1]):
            total += a * b
        assert score == total
