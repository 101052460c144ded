"""Quality scores: hashed word n-grams, logistic regression by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import held_out
from .words import find_words, hash_words, mix64, text_slices

BITS = 18
SCALE = 10.0  # features are shares of a text's n-grams times this
_KINDS = 4  # n-grams that each word begins: word, word pair, shape, shape pair


def _shapes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A code of how each word looks: its outer characters if not letters, its case."""
    upper = np.r_[0, np.cumsum((raw >= 65) & (raw <= 90))]
    lower = np.r_[0, np.cumsum(((raw >= 97) & (raw <= 122)) | (raw >= 128))]
    n_upper, n_lower = upper[ends] - upper[starts], lower[ends] - lower[starts]
    plain = np.arange(256, dtype=np.uint64)
    plain[65:91] = plain[97:123] = plain[128:] = 0
    plain[48:58] = 48
    case = np.where(n_lower == 0, np.where(n_upper > 1, 3, 2), np.where(n_upper > 0, 1, 0)).astype(np.uint64)
    return (plain[raw[starts]] << np.uint64(16)) | (plain[raw[ends - 1]] << np.uint64(8)) | case


def gram_cells(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the texts, and where each text's begin.

    Per word: itself, the pair with the next word (one common cell where both are equal),
    its shape, and the pair of shapes. A text's last word is paired with the text's end.
    """
    starts, ends, first = find_words(raw, offsets)
    n = len(starts)
    if n == 0:
        return np.zeros(0, np.int64), first
    word = hash_words(raw, starts, ends)
    shape = mix64(_shapes(raw, starts, ends) + np.uint64(1 << 40))
    following = np.arange(1, n + 1)
    closes = np.zeros(n, dtype=bool)
    closes[first[1:][np.diff(first) > 0] - 1] = True
    following[-1] = n - 1

    def pair(x: np.ndarray, salt: int) -> np.ndarray:
        after = np.where(closes, np.uint64(salt), x[following])
        return mix64(x * np.uint64(0x9E3779B97F4A7C15) + after + np.uint64(salt))

    words2 = np.where(~closes & (word == word[following]), np.uint64(0x5BD1E995 << 32), pair(word, 7))
    cells = np.empty((n, _KINDS), dtype=np.int64)
    for k, x in enumerate((word, words2, shape, pair(shape, 11))):
        cells[:, k] = (x >> np.uint64(64 - BITS)).astype(np.int64)
    return cells.ravel(), first * _KINDS


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float

    def scores(self, cells: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Sparse dot products: the mean weight of a text's n-grams, and the bias."""
        total = np.r_[0.0, np.cumsum(self.weights[cells].astype(np.float64))]
        n = np.diff(first)
        mean = (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(SCALE * mean + self.bias, -35, 35)))


def fit_ftrl(
    examples: list[tuple[np.ndarray, np.ndarray]],
    labels: list[int],
    *,
    passes: int = 3,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.01,
    l2: float = 0.001,
) -> QualityModel:
    """Follow the regularised leader, one example at a time in the given order.

    An example is (cells, values); its gradient moves only the weights of its own cells,
    each with a rate of its own. The classes weigh alike.
    """
    size = (1 << BITS) + 1  # the last weight is the bias
    z, n = np.zeros(size), np.zeros(size)
    ones = max(sum(labels), 1)
    balance = {1: len(labels) / (2 * ones), 0: len(labels) / (2 * max(len(labels) - ones, 1))}

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - l1, 0)
        return -shrunk / ((beta + np.sqrt(ni)) / alpha + l2)

    for _ in range(passes):
        for (cells, values), label in zip(examples, labels):
            at = np.append(cells, size - 1)
            x = np.append(values, 1.0)
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * balance[label] * x
            grown = ni + g * g
            z[at] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
            n[at] = grown
    w = weights(z, n)
    return QualityModel(w[:-1].astype(np.float32), float(w[-1]))


def train_quality_model(
    docs: DataFrame,
    labels: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    sample_rows: int = 6000,
) -> QualityModel | None:
    """Learn from about ``sample_rows`` labelled rows, half of each label where there are enough.

    Labels other than 0 and 1 are left out, as are held-out keys and null texts; a key
    with several labels counts with each. The rows are those with the smallest hashes of
    the key, found by a threshold from the counts; where keys repeat, those among them with
    the smallest hashes of key and text, under a threshold tightened until at most a quarter
    more rows than asked for are left. Whole texts are used, of rows equal in key and text
    one. None without any.
    """
    known = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).filter(
        F.col("_label").isin(0, 1) & F.col("_key").isNotNull() & ~held_out(F.col("_key"))
    ).distinct()
    counts = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    if not counts:
        return None
    each = sample_rows / 2
    share = [min(1.0, each / counts[v]) if v in counts else 0.0 for v in (0, 1)]
    spread = F.pmod(F.xxhash64("_key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    while True:
        chosen = known.filter(spread < F.when(F.col("_label") == 1, share[1]).otherwise(share[0]))
        keys = {r[0]: r[1] for r in chosen.groupBy("_label").count().collect()}
        over = {v: n for v, n in keys.items() if n > max(1.25 * each, 1)}
        if not over:
            break
        share = [share[v] * each / over[v] if v in over else share[v] for v in (0, 1)]
    # At most 1.25 * sample_rows keys and labels, counted above.
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter(F.col("_text").isNotNull())
    rows = rows.join(F.broadcast(chosen), "_key").select(
        "_key", "_label", "_text", F.xxhash64("_key", "_text").alias("_name")
    )
    drawn = F.pmod(F.xxhash64("_name"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = [1.0, 1.0]
    while True:
        taken = rows.filter(drawn < F.when(F.col("_label") == 1, share[1]).otherwise(share[0]))
        many = {r[0]: r[1] for r in taken.select("_label", "_name").distinct().groupBy("_label").count().collect()}
        over = {v: n for v, n in many.items() if n > max(1.25 * each, 1)}
        if not over:
            break
        share = [share[v] * each / over[v] if v in over else share[v] for v in (0, 1)]
    rows = taken.dropDuplicates(["_label", "_name"]).select("_key", "_label", "_text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells_of, values_of = [], []
            for _, _, raw, offsets in text_slices(batch.column(2)):
                cells, first = gram_cells(raw, offsets)
                for a, b in zip(first[:-1], first[1:]):
                    c, times = np.unique(cells[a:b], return_counts=True)
                    cells_of.append(c.astype(np.int32).tobytes())
                    values_of.append((times * (SCALE / max(b - a, 1))).astype(np.float32).tobytes())
            order = pa.array([str(k) for k in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(
                [order, batch.column(1), pa.array(cells_of, pa.binary()), pa.array(values_of, pa.binary())],
                names=["key", "label", "cells", "values"],
            )

    found = rows.mapInArrow(features, "key string, label int, cells binary, values binary")
    sample = found.orderBy(F.xxhash64("key"), "key", "label", "cells").collect()
    examples = [(np.frombuffer(r["cells"], np.int32), np.frombuffer(r["values"], np.float32)) for r in sample]
    return fit_ftrl(examples, [r["label"] for r in sample]) if sample else None


def score_quality(
    docs: DataFrame,
    model: QualityModel | None,
    *,
    key: str = "doc_id",
    text: str = "text",
    threshold: float = 0.7,
) -> DataFrame:
    """key, score (0 to 1) and predicted (1 from ``threshold`` on) of every whole text.

    A null or empty text has the score of the bias alone; without a model every score is
    0.5. Rows with equal keys are scored each on their own; other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.zeros(0)]
            for _, _, raw, offsets in text_slices(batch.column(1)):
                if model is None:
                    scores.append(np.full(len(offsets) - 1, 0.5))
                else:
                    scores.append(model.scores(*gram_cells(raw, offsets)))
            score = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                names=[key, "score", "predicted"],
            )

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double, predicted int")
