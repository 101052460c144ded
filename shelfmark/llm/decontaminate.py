"""Benchmark items inside documents, with edits: q-gram lemma filter, banded alignment.

An item of n characters found with at most e edits shares at least n - q + 1 - q * e of its
q-grams with that stretch, and they lie on at most e + 1 neighbouring diagonals (place in
the document minus place in the item). Counts in overlapping bands of diagonals therefore
lose no match; bands that reach the bound are aligned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices, text_bytes

Q = 8
SLICE_CHARS = 1 << 20
ITEM_CHARS = 4 << 20  # item text that one pass over the documents looks for
_ALIGN_STEP = 1 << 22  # alignment cells of one batch
_POSTINGS = 1 << 20  # q-gram places of items that are expanded at a time
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Letters:
    """Reduces texts to their letters and digits in lower case."""

    def __init__(self) -> None:
        kept = [chr(c).isalnum() for c in range(0x110000)]
        self.kept = np.array(kept, dtype=bool)

    def reduce(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(code points, place of each in its own text, first index of each text and the end)."""
        low = [t.lower() for t in texts]
        low = [v if len(v) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
               for v, t in zip(low, texts)]
        codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ends = np.cumsum([0] + [len(t) for t in low])
        at = np.flatnonzero(self.kept[codes])
        first = np.searchsorted(at, ends)
        return codes[at], at - np.repeat(ends[:-1], np.diff(first)), first


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of the q-gram that begins at each place."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    part, span = codes.astype(np.uint64) + np.uint64(1), 1
    while span < Q:  # Q is a power of two
        part = part[:-span] * np.uint64(pow(int(_BASE), span, 1 << 64)) + part[span:]
        span *= 2
    part = part ^ (part >> np.uint64(31))
    return part * np.uint64(0xD6E8FEB86659FD93)


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every stretch of so many characters."""
    out = np.zeros(max(len(codes) - size + 1, 0), np.uint64)
    for i in range(size if len(out) else 0):
        out = out * _BASE + codes[i : i + len(out)].astype(np.uint64) + np.uint64(1)
    return out


def budget(size: int, rate: float) -> int:
    """Edits allowed for an item: its share, and few enough for the lemma to hold.

    An item of n characters has at least n - Q + 1 - Q * edits q-grams in common with its
    damaged form, which must be 1 or more: so items of 30 and 31 characters may have 2 edits
    at a rate of 0.1, not 3, and items below 24 fewer than the rate asks wherever it asks more
    than (n - Q) / Q.
    """
    return max(0, min(int(size * rate), (size - Q) // Q))


class Items:
    """The q-gram table of some benchmark items."""

    def __init__(self, items: list[tuple[int, str]], rate: float, min_chars: int):
        letters = Letters()
        rows, short = [], {}
        for name, text in items:
            codes = letters.reduce([text or ""])[0]
            if len(codes) >= max(min_chars, Q):
                rows.append((name, codes))
            elif len(codes):
                short.setdefault(len(codes), {}).setdefault(codes.tobytes(), []).append(name)
        # By length: the hashes to look for, and the items of each spelling.
        self.short = {
            size: (np.unique(np.concatenate([window_hashes(np.frombuffer(c, codes.dtype), size) for c in spelt])), spelt)
            for size, spelt in sorted(short.items())
        }
        self.names = [name for name, _ in rows]
        self.codes = [codes for _, codes in rows]
        self.sizes = np.array([len(c) for c in self.codes], dtype=np.int64)
        self.edits = np.array([budget(len(c), rate) for c in self.codes], dtype=np.int64)
        self.least = self.sizes - Q + 1 - Q * self.edits
        grams = [gram_hashes(c) for c in self.codes]
        look = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(look, kind="stable")
        self.item, self.place = item[order], place[order]
        self.look, first = np.unique(look[order], return_index=True)
        self.first = np.r_[first, len(order)]
        self.bits = 22
        self.seen = np.zeros(1 << self.bits, dtype=bool)
        self.seen[self.look >> np.uint64(64 - self.bits)] = True


def candidate_regions(items: Items, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows (text, item, lowest diagonal, highest diagonal) whose bands reach the bound.

    Diagonals are places in ``codes`` minus places in the item.
    """
    none = np.zeros((0, 4), np.int64)
    look = gram_hashes(codes)
    if not len(look) or not len(items.names):
        return none
    maybe = np.flatnonzero(items.seen[look >> np.uint64(64 - items.bits)])
    found = np.minimum(np.searchsorted(items.look, look[maybe]), len(items.look) - 1)
    real = items.look[found] == look[maybe]
    at, found = maybe[real], found[real]
    doc = np.searchsorted(first, at, side="right") - 1
    inside = at + Q <= first[doc + 1]
    at, found, doc = at[inside], found[inside], doc[inside]
    times = items.first[found + 1] - items.first[found]
    upto = np.cumsum(times)
    most = int(items.sizes.max())
    bands = int(len(codes) + most) + 2
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    reached = []
    lo = 0
    while lo < len(at):
        # Postings are expanded some at a time, in the order of the text.
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] - times[lo] + _POSTINGS, side="right")))
        here = times[lo:hi]
        posting = np.arange(int(here.sum())) + np.repeat(items.first[found[lo:hi]] - (np.cumsum(here) - here), here)
        item = items.item[posting]
        diagonal = np.repeat(at[lo:hi], here) - items.place[posting] + most  # not negative
        band = diagonal // (items.edits[item] + 1)
        key = (np.repeat(doc[lo:hi], here) * len(items.names) + item) * bands + band
        new, count = np.unique(np.concatenate([key, key - (band > 0)]), return_counts=True)
        keys, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
        counts = np.bincount(back, weights=np.concatenate([counts, count]), minlength=len(keys)).astype(np.int64)
        # A band that no later q-gram can fall into is settled; a few for each item stay open.
        item = keys // bands % len(items.names)
        width = items.edits[item] + 1
        settled = np.ones(len(keys), dtype=bool)
        if hi < len(at):
            settled = at[hi] - (items.sizes[item] - Q) + most >= (keys % bands + 2) * width
        reached.append(keys[settled & (counts >= items.least[item])])
        keys, counts = keys[~settled], counts[~settled]
        lo = hi
    if not reached:
        return none
    keys = np.sort(np.concatenate(reached))
    item = keys // bands % len(items.names)
    low = (keys % bands) * (items.edits[item] + 1) - most
    return np.stack([keys // bands // len(items.names), item, low, low + 2 * items.edits[item] + 1], axis=1)


def find_short(items: Items, codes: np.ndarray, place: np.ndarray, first: np.ndarray) -> list[tuple]:
    """(text, item name, 0, start, end) of the first verbatim place of each short item, as whole words."""
    # A character begins a word if the one before it is no neighbour in the text.
    begins = np.r_[True, np.diff(place) > 1, True]
    begins[first] = True
    found = []
    for size, (hashes, spelt) in items.short.items():
        look = window_hashes(codes, size)
        at = np.flatnonzero(begins[: len(look)] & begins[size : size + len(look)])
        at = at[np.isin(look[at], hashes)]
        doc = np.searchsorted(first, at, side="right") - 1
        inside = at + size <= first[doc + 1]
        seen = set()
        for d, s in zip(doc[inside].tolist(), at[inside].tolist()):
            letters = codes[s : s + size].tobytes()
            if (d, letters) not in seen:
                seen.add((d, letters))
                found += [(d, name, 0, s, s + size) for name in spelt.get(letters, ())]
    return found


def align(item: np.ndarray, codes: np.ndarray, low: np.ndarray, high: int, most: int, begin: np.ndarray,
          end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, start, end) of the item's best stretch in each region of ``codes``.

    A region's paths stay within ``most`` of its diagonals low .. low + high and inside
    begin .. end. Start and end are places in ``codes``; edits above ``most`` mean none. Among
    stretches of equal edits the one that begins first is taken, then the shortest.
    """
    n, rows = len(item), len(low)
    span = high + 2 * most + 1
    unit = np.int64(1 << 24)
    column = np.arange(span, dtype=np.int64)
    base = low - most  # the diagonal of column 0
    at = base[:, None] + column  # place before which the item begins on each diagonal
    never = np.int64(most + 1) * unit * 4
    # A value is edits * unit + start, the start counted from the first column.
    value = np.where((at >= begin[:, None]) & (at <= end[:, None]), column, never)
    shift = column * unit
    for i in range(n):
        place = at + i  # the document's character that item[i] may match
        ok = (place >= begin[:, None]) & (place < end[:, None])
        same = codes[np.clip(place, 0, len(codes) - 1)] == item[i]
        step = value + np.where(ok, np.where(same, 0, unit), never)
        skip = np.full_like(value, never)  # the item's character is missing in the document
        skip[:, :-1] = value[:, 1:] + unit
        value = np.minimum(step, skip)
        # More characters in the document: along the row, each costs one edit.
        value = np.minimum.accumulate(value - shift, axis=1) + shift
        value = np.where((place + 1 >= begin[:, None]) & (place + 1 <= end[:, None]), value, never)
        value = np.minimum(value, never)
    best = value.argmin(axis=1)
    least = value[np.arange(rows), best]
    return least // unit, base + least % unit, base + best + n


def _take_exact(best: dict, k: int, item: np.ndarray, codes: np.ndarray, first: np.ndarray, regions: np.ndarray,
                high: int) -> np.ndarray:
    """Enter verbatim occurrences into ``best``; which regions need no alignment for them."""
    at = regions[:, 2, None] + np.arange(high + 1)
    begin, end = first[regions[:, 0]], first[regions[:, 0] + 1]
    fits = (at >= begin[:, None]) & (at + len(item) <= end[:, None])
    row, column = np.nonzero(fits)
    start = at[row, column]
    for i in range(len(item)):
        same = codes[start + i] == item[i]
        row, start = row[same], start[same]
        if not len(row):
            break
    for doc, s in zip(regions[row, 0].tolist(), start.tolist()):
        found = (0, s, s + len(item))
        if (doc, k) not in best or found < best[doc, k]:
            best[doc, k] = found
    return np.isin(regions[:, 0], regions[row, 0])


def find_items(items: Items, texts: list[str], letters: Letters) -> list[tuple]:
    """(text, item name, edits, first character, character after the last) of the best place of each."""
    codes, place, first = letters.reduce(texts)
    regions = candidate_regions(items, codes, first)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for k in np.unique(regions[:, 1]):
        own = regions[regions[:, 1] == k]
        most = int(items.edits[k])
        high = 2 * most + 1
        step = max(1, _ALIGN_STEP // (high + 2 * most + 1))
        pieces = [own[lo : lo + step] for lo in range(0, len(own), step)]
        sure = [part[_take_exact(best, int(k), items.codes[k], codes, first, part, high), 0] for part in pieces]
        own = own[~np.isin(own[:, 0], np.concatenate(sure))]
        for lo in range(0, len(own), step):
            part = own[lo : lo + step]
            doc = part[:, 0]
            edits, start, end = align(items.codes[k], codes, part[:, 2], high, most, first[doc], first[doc + 1])
            for i in np.flatnonzero(edits <= most):
                if end[i] <= start[i]:
                    continue
                found = (int(edits[i]), int(start[i]), int(end[i]))
                name = (int(doc[i]), int(k))
                if name not in best or found < best[name]:
                    best[name] = found
    hits = [(d, items.names[k], e, s, t) for (d, k), (e, s, t) in sorted(best.items())]
    hits += find_short(items, codes, place, first)
    return [(d, name, e, int(place[s]), int(place[t - 1]) + 1) for d, name, e, s, t in hits]


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    rate: float = 0.1,
    min_chars: int = 24,
) -> DataFrame:
    """key, item, edits, start_char, end_char: every benchmark item found in a document.

    Compared are letters and digits in lower case; an item may differ by ``rate`` of its
    characters (insertions, deletions, exchanges; see ``budget``). Items of fewer than
    ``min_chars`` such characters (or than a q-gram) are leaks only where they stand verbatim,
    as whole words. One row per document and item, at its best place; places are characters of the whole text. Null texts and
    items hold nothing. Repeated rows are searched each on their own; other columns are
    ignored. A benchmark of more text than ITEM_CHARS is looked for in several passes, so
    what a task holds of it is bounded.
    """
    kinds = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    schema = f"`{key}` {kinds[0]}, `{item}` {kinds[1]}, edits long, start_char long, end_char long"
    out = None
    for table in _item_tables(benchmark, item, item_text, rate, min_chars):
        part = docs.select(key, text).mapInArrow(_searcher(table, key, item), schema)
        out = part if out is None else out.unionByName(part)
    return out


def keep_clean(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    rate: float = 0.1,
    min_chars: int = 24,
) -> DataFrame:
    """The rows in which ``find_leaks`` finds no benchmark item, unchanged."""
    for table in _item_tables(benchmark, item, item_text, rate, min_chars):
        docs = docs.mapInArrow(_cleaner(table, text), docs.schema)
    return docs


def _item_tables(
    benchmark: DataFrame, item: str, item_text: str, rate: float, min_chars: int
) -> Iterator[Items]:
    """The benchmark in parts of about ITEM_CHARS; the bound of what is sent to every task."""
    wanted = benchmark.select(F.col(item).alias("_item"), F.col(item_text).alias("_text")).filter(F.col("_text").isNotNull())
    size = wanted.agg(F.sum(F.length("_text"))).first()[0] or 0
    passes = max(1, -(-size // ITEM_CHARS))
    for turn in range(passes):
        part = wanted.filter(F.pmod(F.xxhash64("_item", "_text"), F.lit(passes)) == turn)
        yield Items([(r[0], r[1]) for r in part.orderBy("_item", "_text").collect()], rate, min_chars)


def _cleaner(table: Items, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            _, offsets = text_bytes(column)
            keep = np.ones(batch.num_rows, dtype=bool)
            for lo, hi in slices(offsets, SLICE_CHARS):
                texts = [t or "" for t in column.slice(lo, hi - lo).to_pylist()]
                keep[[lo + row[0] for row in find_items(table, texts, letters)]] = False
            yield batch.filter(pa.array(keep))

    return run


def _searcher(table: Items, key: str, item: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters()
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for lo, hi in slices(offsets, SLICE_CHARS):
                texts = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                found = find_items(table, texts, letters)
                if found:
                    doc, k, edits, start, end = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array([lo + d for d in doc])),
                            pa.array(k),
                            pa.array(edits, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()),
                        ],
                        names=[key, item, "edits", "start_char", "end_char"],
                    )

    return run
