"""Language identification: family first, then one-versus-one linear SVMs within the family."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import trimmed
from .words import lowered, slices, text_bytes

UNDETERMINED = "und"

# Language codes by family. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "turkic": ["az", "kk", "ky", "tr", "tt", "uz"],
    "uralic": ["et", "fi", "hu"],
    "indo-aryan": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "semitic": ["am", "ar", "he", "mt"],
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

DIMENSIONS = 1 << 13
ORDERS = (1, 2, 3, 4)
_PLAIN = lowered(np.arange(256, dtype=np.uint8)).copy()
_PLAIN[:128][~np.isin(np.arange(128), np.arange(97, 123)) & ~np.isin(np.arange(128), np.arange(65, 91))] = 32


# Cells of grams of spaces alone (digits and signs count as spaces): they tell nothing.
_BLANK = np.array([((0x20202020 >> (8 * (4 - k))) + k) * 0x9E3779B1 % (1 << 32) >> (32 - 13) for k in ORDERS])
FLOOR = 0.05  # part of a language's gram shares that all cells have alike
REACH = 3.0  # texts this many times as odd as one in a hundred training rows have no language
LEAST_REACH = 10.0  # the limit is never stricter, however alike the training rows are
REJECT = 0.25  # the score at that limit


def family_of(language: str) -> str:
    return _FAMILY_OF.get(language.lower().split("-")[0], language)


def gram_counts(raw: np.ndarray, offsets: np.ndarray, step: int = 1 << 22) -> np.ndarray:
    """Hashed counts of the byte 1- to 4-grams of each text, one row per text.

    A-Z count as a-z, other ASCII characters as space; no gram reaches over a text's end.
    Long texts are gone through in overlapping steps.
    """
    rows = len(offsets) - 1
    counts = np.zeros(rows * DIMENSIONS, dtype=np.float32)
    reach = max(ORDERS) - 1
    for lo in range(0, len(raw), step):
        hi = min(lo + step, len(raw))
        part = _PLAIN[raw[lo : min(hi + reach, len(raw))]].astype(np.uint32)
        n = hi - lo
        cuts = np.clip(offsets - lo, 0, len(part))
        row = np.repeat(np.arange(rows), np.diff(cuts))
        gram = np.zeros(len(part), dtype=np.uint32)
        for order in range(1, reach + 2):
            tail = len(part) - order + 1
            if tail <= 0:
                break
            gram[:tail] |= part[order - 1 :] << np.uint32(8 * (order - 1))
            m = min(n, tail)
            inside = row[:m] == row[order - 1 : order - 1 + m]
            cell = ((gram[:m] + np.uint32(order)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)
            at = row[:m] * DIMENSIONS + cell
            counts += np.bincount(at[inside], minlength=len(counts)).astype(np.float32)
    return counts.reshape(rows, DIMENSIONS)


def gram_vectors(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of the counts, each row of length one (an empty text: zeros)."""
    x = np.sqrt(gram_counts(raw, offsets))
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def fit_svm(x: np.ndarray, y: np.ndarray, strength: float = 1e-4, rounds: int = 150) -> np.ndarray:
    """A linear SVM (squared hinge) by accelerated gradient steps; y is +1 or -1.

    The classes weigh alike however many rows they have. The last weight is the bias.
    """
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = np.zeros(x.shape[1] + 1, dtype=np.float32)
    ahead, t, rate = w.copy(), 1.0, 1 / (2 * 2.0 + strength)
    for _ in range(rounds):
        gap = np.maximum(0, 1 - y * (x @ ahead[:-1] + ahead[-1])).astype(np.float32)
        pull = -2 * weight * y * gap
        gradient = np.append(x.T @ pull, pull.sum()).astype(np.float32)
        gradient[:-1] += strength * ahead[:-1]
        new = ahead - rate * gradient
        t_new = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w


@dataclass
class PairwiseVote:
    """One linear SVM for each pair of classes; the classes' mean win probabilities decide."""

    classes: list[str]
    weights: np.ndarray  # one column per pair, the bias in the last row
    pairs: list[tuple[int, int]]

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray, classes: list[str]) -> PairwiseVote:
        pairs = [(a, b) for a in range(len(classes)) for b in range(a + 1, len(classes))]
        columns = []
        for a, b in pairs:
            rows = np.flatnonzero((labels == classes[a]) | (labels == classes[b]))
            y = np.where(labels[rows] == classes[a], 1.0, -1.0).astype(np.float32)
            columns.append(fit_svm(x if len(rows) == len(x) else x[rows], y))
        weights = np.stack(columns, axis=1) if columns else np.zeros((x.shape[1] + 1, 0), np.float32)
        return cls(classes, weights, pairs)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Rows of class probabilities; ties go to the first class."""
        out = np.zeros((len(x), len(self.classes)))
        if not self.pairs:
            out[:] = 1.0
            return out
        margin = x @ self.weights[:-1] + self.weights[-1]
        win = 1 / (1 + np.exp(-4 * np.clip(margin, -8, 8)))
        for k, (a, b) in enumerate(self.pairs):
            out[:, a] += win[:, k]
            out[:, b] += 1 - win[:, k]
        out /= len(self.classes) - 1
        return out


def _shares(x: np.ndarray) -> np.ndarray:
    """Each text's shares of its grams, without those of spaces alone."""
    shares = x * x
    shares[:, _BLANK[_BLANK < x.shape[1]]] = 0
    whole = shares.sum(axis=1, keepdims=True)
    return shares / np.where(whole > 0, whole, 1)


@dataclass
class Oddness:
    """How far a text's grams are from those of a language, against the language's own texts.

    The mean log probability of a text's grams under the shares in the training rows, below
    the median of those rows, in units of the chance spread of a text of so many different
    grams: a short or monotonous text is allowed more. ``limit`` is where texts are odd.
    """

    logs: dict[str, np.ndarray]
    middle: dict[str, float]
    limit: float

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray, step: int = 64) -> Oddness:
        """Each training row is measured against the others of its language."""
        logs, middle, odd = {}, {}, []
        for name in sorted(set(labels)):
            rows = np.flatnonzero(labels == name)
            parts = [rows[a : a + step] for a in range(0, len(rows), step)]
            total = np.zeros(x.shape[1])
            for part in parts:
                total += _shares(x[part]).sum(axis=0)
            logs[name] = cls._log(total, len(rows)).astype(np.float32)
            means, spreads = [], []
            for part in parts:
                shares = _shares(x[part])
                means.append((shares * cls._log(np.maximum(total - shares, 0), len(rows) - 1)).sum(axis=1))
                spreads.append(np.sqrt((shares * shares).sum(axis=1)))
            mean, spread = np.concatenate(means), np.concatenate(spreads)
            middle[name] = float(np.median(mean))
            odd.append((middle[name] - mean) / np.where(spread > 0, spread, 1))
        return cls(logs, middle, max(REACH * float(np.quantile(np.concatenate(odd), 0.99)), LEAST_REACH))

    @staticmethod
    def _log(total: np.ndarray, rows: int) -> np.ndarray:
        return np.log((1 - FLOOR) * total / max(rows, 1) + FLOOR / total.shape[-1])

    def fits(self, x: np.ndarray, name: str) -> np.ndarray:
        """1 up to half the limit, falling to REJECT at the limit and on towards 0."""
        shares = _shares(x)
        spread = np.sqrt((shares * shares).sum(axis=1))
        odd = (self.middle[name] - shares @ self.logs[name]) / np.where(spread > 0, spread, 1)
        return np.minimum(1.0, REJECT ** (2 * odd.astype(np.float64) / self.limit - 1))


@dataclass
class LanguageModel:
    families: PairwiseVote
    within: dict[str, PairwiseVote]
    oddness: Oddness

    @classmethod
    def fit(cls, x: np.ndarray, languages: list[str]) -> LanguageModel:
        labels = np.array(languages, dtype=object)
        family = np.array([family_of(v) for v in languages], dtype=object)
        names = sorted(set(family))
        within = {
            f: PairwiseVote.fit(x[family == f], labels[family == f], sorted(set(labels[family == f]))) for f in names
        }
        return cls(PairwiseVote.fit(x, family, names), within, Oddness.fit(x, labels))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        p = self.families.probabilities(x)
        chosen = p.argmax(axis=1)
        out, score = [""] * len(x), p[np.arange(len(x)), chosen]
        for k, family in enumerate(self.families.classes):
            rows = np.flatnonzero(chosen == k)
            if len(rows):
                q = self.within[family].probabilities(x[rows])
                best = q.argmax(axis=1)
                for row, j in zip(rows, best):
                    out[row] = self.within[family].classes[j]
                score[rows] *= q[np.arange(len(rows)), best]
        # The vote only compares languages; whether the text is like the winner's at all is another matter.
        named = np.array(out, dtype=object)
        for name in set(out):
            rows = np.flatnonzero(named == name)
            score[rows] = np.minimum(score[rows], self.oddness.fits(x[rows], name))
        return out, score


def held_out(key: Column) -> Column:
    """Rows kept from learning: crc32 of the key's text, modulo 4, is 2."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _row_slices(column: pa.Array, rows: int = 256) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, offsets = text_bytes(column)
    for lo, hi in slices(offsets):
        for a in range(lo, hi, rows):
            b = min(a + rows, hi)
            yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def train_language_model(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = 1500
) -> LanguageModel | None:
    """Fit on about ``sample_rows`` different rows with a language and text, as many of each language.

    The rows are those with the smallest hashes of key and text, found by a threshold for
    each language from its count, which is tightened while it takes a quarter too many;
    equal rows count once. Whole texts are used. The number of languages must be small,
    their counts come to the driver. None without a labelled row.
    """
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(key))).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.col(text)).alias("_name")
    )
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").agg(F.approx_count_distinct("_name")).collect()}
    if not counts:
        return None
    each = sample_rows / len(counts)
    bounds = {k: min(1.0, each / max(n, 1)) for k, n in counts.items()}
    spread = F.pmod(F.col("_name"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    while True:
        bound = F.create_map(*[F.lit(v) for pair in bounds.items() for v in pair])
        taken = labelled.filter(spread < bound[F.col("lang")])
        many = {r[0]: r[1] for r in taken.select("lang", "_name").distinct().groupBy("lang").count().collect()}
        over = {k: n for k, n in many.items() if n > max(1.25 * each, 1)}
        if not over:
            break
        bounds |= {k: bounds[k] * each / n for k, n in over.items()}
    sample = taken.dropDuplicates(["lang", "_name"]).select("lang", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in _row_slices(batch.column(1)):
                x = gram_vectors(raw, offsets)
                cells = [np.flatnonzero(v) for v in x]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([c.astype(np.uint16).tobytes() for c in cells], pa.binary()),
                        pa.array([v[c].astype(np.float32).tobytes() for v, c in zip(x, cells)], pa.binary()),
                    ],
                    names=["lang", "cells", "values"],
                )

    rows = sample.mapInArrow(trimmed(vectors), "lang string, cells binary, values binary").orderBy("lang", "cells").collect()
    x = np.zeros((len(rows), DIMENSIONS), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["cells"], np.uint16)] = np.frombuffer(r["values"], np.float32)
    return LanguageModel.fit(x, [r["lang"] for r in rows]) if rows else None


_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def judge(column: pa.Array, model: LanguageModel | None) -> tuple[list[str], np.ndarray]:
    """The language and score of every text of an Arrow column."""
    names, scores = [], [np.zeros(0)]
    for a, b, raw, offsets in _row_slices(column):
        if model is None:
            found, score = [UNDETERMINED] * (b - a), np.zeros(b - a)
        else:
            found, score = model.predict(gram_vectors(raw, offsets))
        seen = np.r_[0, np.cumsum(_LETTER[raw])][offsets]
        for i in np.flatnonzero(np.diff(seen) == 0):
            if not any(map(str.isalpha, column[a + int(i)].as_py() or "")):
                found[i], score[i] = UNDETERMINED, 0.0
        names += found
        scores.append(score)
    return names, np.concatenate(scores)


def identify_language(
    docs: DataFrame, model: LanguageModel | None, *, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """key, lang_pred and score (0 to 1) of every whole text.

    ``und`` with score 0 for a null text, one without a letter, or without a model. The
    score is the probability of the family times that of the language within it, or how well
    the text's grams fit that language if that is less: below 0.25 the text is further from
    the language than its training rows, far beyond chance, and may be in none that was
    learned. Rows with equal keys are judged each on their own; other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = judge(batch.column(1), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores)], names=[key, "lang_pred", "score"]
            )

    return docs.select(key, text).mapInArrow(trimmed(run), f"`{key}` {kind}, lang_pred string, score double")


def keep_identified(
    docs: DataFrame, model: LanguageModel | None, *, text: str = "text", min_score: float = REJECT
) -> DataFrame:
    """The rows whose language is determined with at least ``min_score``, unchanged.

    Rows are judged as by ``identify_language``. Without a model (no labelled row to learn
    from) only texts without a letter go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            if model is None:
                keep = [any(map(str.isalpha, t or "")) for t in column.to_pylist()]
            else:
                names, scores = judge(column, model)
                keep = [n != UNDETERMINED and s >= min_score for n, s in zip(names, scores)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)
