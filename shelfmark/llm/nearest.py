"""Nearest neighbours by inner product, over randomly rotated one-bit codes.

A vector is centred, rotated at random and kept as the signs of its components, with two
correction scalars. A code is made once and stays packed; a query's rotated components are
cut to a few bit planes, and counts of the bits that a code and a plane share give an estimate
of the inner product with a known error bound. Only vectors whose upper bound reaches a
query's best exact scores are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .storage import stored

DATA_BLOCK = 8_192
QUERY_BLOCK = 16_384
BLOCK_NUMBERS = 8 << 20  # components that a block of long vectors holds at most


def usable(vector: Column) -> Column:
    """Vectors that are not null, empty or zero and hold finite numbers alone."""
    finite = F.forall(vector, lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0)


def rotation(dimensions: int, bits: int, seed: int) -> np.ndarray:
    """A random rotation into ``bits`` dimensions (rows orthonormal), the same for the same seed.

    More bits than dimensions amount to a vector padded with zeros before it is rotated; the
    error of an estimate falls with the square root of the bits.
    """
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, dimensions)))
    return (q * np.sign(np.diag(r))).T


PLANES = 5  # bits that a rotated component of a query is cut to


class Codes:
    """One-bit codes of vectors around a centre: signs packed into words, and two scalars each."""

    def __init__(self, words: np.ndarray, scale: np.ndarray, error: np.ndarray, size: int):
        self.words, self.scale, self.error, self.size = words, scale, error, size

    @classmethod
    def of(cls, vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> Codes:
        centred = vectors - centre
        norms = np.sqrt((centred * centred).sum(axis=1))
        turned = (centred / np.where(norms > 0, norms, 1)[:, None]) @ turn
        size = turn.shape[1]
        # How far the code points the vector's way: 1 for a perfect code, about 0.8 otherwise.
        fit = np.maximum(np.abs(turned).sum(axis=1) / np.sqrt(size), 1e-9)
        scale = norms / fit / np.sqrt(size)
        error = norms * np.sqrt(np.maximum(1 - fit**2, 0)) / fit / np.sqrt(max(size - 1, 1))
        return cls(in_words(turned > 0), scale.astype(np.float32), error.astype(np.float32), size)

    def estimates(self, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unbiased estimates of the inner products, a row per query, and their errors.

        An error is about normal; its size has a part of the code (the vector's ``error`` times
        the query's length) and a part of the planes (what cutting the query has left over).
        """
        turned = queries @ turn
        low = turned.min(axis=1, keepdims=True)
        step = np.maximum(np.ptp(turned, axis=1, keepdims=True) / (2**PLANES - 1), 1e-30)
        levels = np.rint((turned - low) / step)
        left_over = np.sqrt(((turned - low - step * levels) ** 2).sum(axis=1))
        planes = [in_words((levels.astype(np.int64) >> p) & 1 == 1) for p in range(PLANES)]
        columns = np.ascontiguousarray(self.words.T)
        ones = np.bitwise_count(columns).sum(axis=0, dtype=np.uint32)
        found = np.empty((len(queries), len(self.words)), dtype=np.float32)
        for row in range(len(queries)):
            shared = np.zeros(len(self.words), dtype=np.uint32)
            for p, plane in enumerate(planes):
                shared += np.bitwise_count(columns & plane[row][:, None]).sum(axis=0, dtype=np.uint32) << np.uint32(p)
            # The sum over the set bits twice, less the sum over all: the product with the signs.
            total = low[row] * self.size + step[row] * levels[row].sum()
            found[row] = 2 * (low[row] * ones + step[row] * shared) - total
        found *= self.scale
        found += (queries @ centre).astype(np.float32)[:, None]
        length = np.sqrt((queries * queries).sum(axis=1))
        off = np.hypot(
            length.astype(np.float32)[:, None] * self.error, left_over.astype(np.float32)[:, None] * self.scale
        )
        return found, off


def in_words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits packed into 64-bit words, the last one filled up with zeros."""
    padded = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), dtype=bool)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1).view(np.uint64)


def exact_products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of paired rows in double precision, added up in component order."""
    total = np.zeros(len(queries))
    for d in range(queries.shape[1]):
        total += queries[:, d] * vectors[:, d]
    return total


def search_block(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, codes: Codes,
    centre: np.ndarray, turn: np.ndarray, k: int, errors: float,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest vectors of a block to each query: (query row, vector row, score)."""
    order = np.argsort(ids, kind="stable")
    in_order = ids[order]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, len(queries), 32):
        q, names = queries[lo : lo + 32], query_ids[lo : lo + 32]
        rows, n = len(q), len(ids)
        estimate, error = codes.estimates(q, centre, turn)
        # A row with the query's own key takes no part.
        a, b = np.searchsorted(in_order, names), np.searchsorted(in_order, names, side="right")
        own = np.repeat(np.arange(rows), b - a), order[np.repeat(a - np.cumsum(b - a) + (b - a), b - a) + np.arange((b - a).sum())]
        estimate[own] = -np.inf
        # The exact scores of the best estimates are the floor that upper bounds must reach.
        first = min(4 * k, n)
        best = np.argpartition(estimate, n - first, axis=1)[:, n - first :]
        score = exact_products(np.repeat(q, first, axis=0), vectors[best.ravel()]).reshape(rows, first)
        score[np.isneginf(np.take_along_axis(estimate, best, 1))] = -np.inf
        floor = np.partition(score, first - k, axis=1)[:, first - k] if first > k else np.full(rows, -np.inf)
        slack = np.float32(1e-5) * (np.abs(floor) + 1)  # for the rounding of the estimates
        upper = estimate + np.float32(errors) * error
        row, at = np.nonzero(upper >= np.where(np.isfinite(floor), floor - slack, -3e38)[:, None])
        rough = np.concatenate(
            [np.zeros(0)] + [np.einsum("ij,ij->i", q[row[i : i + 8192]], vectors[at[i : i + 8192]])
                             for i in range(0, len(row), 8192)]
        )
        near = rough >= np.where(np.isfinite(floor), floor - slack, -np.inf)[row]
        row, at = row[near], at[near]
        score = exact_products(q[row], vectors[at])
        by_score = np.lexsort((ids[at], -score, row))
        row, at, score = row[by_score], at[by_score], score[by_score]
        head = np.searchsorted(row, np.arange(rows))
        keep = np.arange(len(row)) - head[row] < k
        found.append((row[keep] + lo, at[keep], score[keep]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int),) * 2 + (np.zeros(0),)


def nearest_by_product(
    vectors: DataFrame,
    queries: DataFrame,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 20,
    bits: int | None = None,
    errors: float = 4.0,
    seed: int = 7,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k vectors of the largest inner product.

    A code has ``bits`` bits, by default four for each dimension. ``errors`` is the width of
    the bound in units of the codes' error; the default misses a neighbour practically never. Null, empty, zero and non-finite vectors take no part,
    nor does a row with the query's own key; vectors are compared with those of their own
    length. Ties go to the smaller key; repeated rows count as rows. Blocks of vectors, with the
    codes made for them once, meet blocks of queries, each pair as one task's work, so nothing
    is broadcast and no pair of rows is ever a row; a block's answer is at most k rows for each query.
    """
    both_narrow = all(df.schema[vector].dataType == T.ArrayType(T.FloatType()) for df in (vectors, queries))

    def clean(df: DataFrame) -> DataFrame:
        kind = "float" if both_narrow else "double"
        wide = df.select(F.col(key).cast("long").alias("_key"), F.col(vector).cast(f"array<{kind}>").alias("_v"))
        return wide.filter(F.col("_key").isNotNull() & usable(F.col("_v"))).withColumn("_n", F.size("_v"))

    data = stored(clean(vectors), "vectors")
    asked = stored(clean(queries), "queries")
    sizes = {r[0]: r[1] for r in data.groupBy("_n").count().collect()}
    n_asked = {r[0]: r[1] for r in asked.groupBy("_n").count().collect()}
    out = None
    for n in sorted(set(sizes) & set(n_asked)):
        own, wanted = data.filter(F.col("_n") == n), asked.filter(F.col("_n") == n)
        centre = np.array(own.agg(*[F.avg(F.col("_v")[i].cast("double")) for i in range(n)]).first(), dtype=np.float64)
        part = _search(own, wanted, sizes[n], n_asked[n], centre, rotation(n, max(bits or 4 * n, n), seed), k, errors)
        out = part if out is None else out.unionByName(part)
    schema = "query_id long, rank int, vec_id long, score double"
    if out is None:
        return vectors.sparkSession.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _search(
    data: DataFrame, asked: DataFrame, n_data: int, n_asked: int, centre: np.ndarray, turn: np.ndarray, k: int,
    errors: float,
) -> DataFrame:
    n = len(centre)
    most = max(256, BLOCK_NUMBERS // n)
    blocks = max(1, -(-n_data // min(DATA_BLOCK, most)))
    shares = max(1, -(-n_asked // min(QUERY_BLOCK, most)))

    def block_of(df: DataFrame, count: int) -> DataFrame:
        return df.withColumn("_block", F.pmod(F.xxhash64("_key"), F.lit(count)).cast("int"))

    # Floats stay floats on the way; they are doubles again before anything is computed.
    narrow = data.schema["_v"].dataType.elementType == T.FloatType()
    number = np.float32 if narrow else np.float64
    schema = "_block int, _keys binary, _rows binary, _words binary, _scale binary, _error binary"

    def packed(df: DataFrame, coded: bool) -> DataFrame:
        """A row per block and Arrow batch: keys, components and, of the data, codes as bytes."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                block, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                flat = batch.column(2).flatten().to_numpy().reshape(-1, n)
                parts = [keys, flat]
                if coded:
                    codes = Codes.of(flat.astype(np.float64), centre, turn)
                    parts += [codes.words, codes.scale, codes.error]
                chosen = [np.flatnonzero(block == b) for b in np.unique(block)]
                columns = [pa.array([part[c].tobytes() for c in chosen], pa.binary()) for part in parts]
                columns += [pa.nulls(len(chosen), pa.binary())] * (5 - len(parts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(block[c[0]]) for c in chosen], pa.int32()), *columns],
                    names=["_block", "_keys", "_rows", "_words", "_scale", "_error"],
                )

        return df.select("_block", "_key", "_v").mapInArrow(run, schema)

    # Codes are made once for each vector, before its block is sent to the shares of queries.
    bytes_ = ["_keys", "_rows", "_words", "_scale", "_error"]
    left = packed(block_of(data, blocks), True).select(
        F.col("_block").alias("_data"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("_asked"),
        F.lit(False).alias("_is_query"), *bytes_,
    )
    right = packed(block_of(asked, shares), False).select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_data"), F.col("_block").alias("_asked"),
        F.lit(True).alias("_is_query"), *bytes_,
    )

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        def joined(rows: pd.DataFrame, column: str, kind: type) -> np.ndarray:
            return np.frombuffer(b"".join(rows[column]), kind)

        asking, given = frame[frame["_is_query"]], frame[~frame["_is_query"]]
        query_ids, ids = joined(asking, "_keys", np.int64), joined(given, "_keys", np.int64)
        if not len(query_ids) or not len(ids):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        queries = joined(asking, "_rows", number).reshape(-1, n).astype(np.float64)
        vectors = joined(given, "_rows", number).reshape(-1, n).astype(np.float64)
        codes = Codes(
            joined(given, "_words", np.uint64).reshape(len(ids), -1), joined(given, "_scale", np.float32),
            joined(given, "_error", np.float32), turn.shape[1],
        )
        row, at, score = search_block(query_ids, queries, ids, vectors, codes, centre, turn, k, errors)
        return pd.DataFrame({"query_id": query_ids[row], "vec_id": ids[at], "score": score})

    return left.unionByName(right).groupBy("_data", "_asked").applyInPandas(
        meet, "query_id long, vec_id long, score double"
    )
