"""Removal of word windows that occur earlier, by super-k-mers in minimiser buckets.

A window's minimiser is the smallest hash among the short word runs inside it. Consecutive
windows mostly share it, so a run of them travels as one packed string of words to the
minimiser's bucket; equal windows have equal minimisers and meet there. In the bucket the
windows are sorted, and the strings of those that look equal are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import cut, give_back, trimmed
from .words import find_words, hash_words, mix64, text_slices

RUN_WORDS = 4  # words of the runs that minimisers are chosen from
LONGEST = 64  # windows of one packed string
BUCKET_BYTES = 12 << 20  # packed text that a bucket holds on average
SHARE_BYTES = 32 << 20  # text whose stretches are brought together in one group
FLUSH_BYTES = 20 << 20  # packed text that a task gathers before it writes
KNOWN_STRINGS = 20_000  # repeated strings that a task remembers
HOT_FACTOR = 8  # a cell is hot from so many times the mean count
_NULL_KEY = -(2**63)
_STEP = 0xD6E8FEB86659FD93


def _rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """An order-dependent hash of every ``size`` consecutive items, by doubling; mixed."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, part, span, left = None, 0, hashes, 1, size
    base = np.uint64(_STEP)
    while left:
        if left & 1:
            piece = part[have : have + n]
            out = piece.copy() if out is None else out * _power(base, span) + piece
            have += span
        left >>= 1
        if left:
            part = part[:-span] * _power(base, span) + part[span:]
            span *= 2
    return mix64(out)


def _power(base: np.uint64, exponent: int) -> np.uint64:
    return np.uint64(pow(int(base), exponent, 1 << 64))


def _sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """The smallest of every ``size`` consecutive values."""
    n = len(values) - size + 1
    if n <= 0:
        return values[:0]
    part, span = values, 1
    while span * 2 <= size:
        part = np.minimum(part[:-span], part[span:])
        span *= 2
    return np.minimum(part[:n], part[size - span : size - span + n])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of all given ranges, one after the other."""
    total = int(sizes.sum())
    first = np.cumsum(sizes) - sizes
    return np.arange(total) + np.repeat(starts - first, sizes)


def _joined(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words with one space behind each, and where each begins (and the end)."""
    sizes = ends - starts + 1
    begin = np.r_[0, np.cumsum(sizes)]
    places = _ranges(starts, sizes)
    out = raw[np.minimum(places, max(len(raw) - 1, 0))]
    out[begin[1:] - 1] = 32
    return out, begin


class Packer:
    """Cuts texts into super-k-mers; strings repeated within the task go on once."""

    def __init__(self, window: int, hot: np.ndarray, buckets: int):
        self.window, self.hot, self.buckets = window, hot, buckets
        self.shift = np.uint64(64 - (len(hot).bit_length() - 1))
        self.known: dict[bytes, tuple[int, int, int]] = {}

    def pack(self, keys: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> tuple | None:
        """(bucket, key, start, words, bytes of each string; the strings; repeats found).

        A key is a row of two numbers, in their order.
        """
        starts, ends, first = find_words(raw, offsets)
        k, m = self.window, min(RUN_WORDS, self.window)
        if len(starts) < k:
            return None
        text, begin = _joined(raw, starts, ends)
        grams = _rolled(hash_words(raw, starts, ends), m)
        # Runs in crowded cells come last in the order, so that windows choose rarer ones.
        order = (grams >> np.uint64(1)) | (self.hot[(grams >> self.shift).astype(np.int64)].astype(np.uint64) << np.uint64(63))
        smallest = _sliding_min(order, k - m + 1)
        sizes = np.maximum(np.diff(first) - k + 1, 0)
        windows = _ranges(first[:-1], sizes)
        if not len(windows):
            return None
        row = np.repeat(np.arange(len(sizes)), sizes)
        chosen = smallest[windows]
        new = np.r_[True, (np.diff(windows) != 1) | (row[1:] != row[:-1]) | (chosen[1:] != chosen[:-1])]
        since = np.arange(len(windows))
        since = since - np.maximum.accumulate(np.where(new, since, 0))
        heads = np.flatnonzero(since % LONGEST == 0)
        count = np.diff(np.r_[heads, len(windows)])
        at, n_words = windows[heads], count + k - 1
        key, start = keys[row[heads]], at - first[row[heads]]
        low, high = begin[at], begin[at + n_words]
        bucket = (mix64(chosen[heads]) % np.uint64(self.buckets)).astype(np.int32)
        keep, repeats = self._combine(text, key, start, n_words, low, high)
        return text, bucket[keep], key[keep], start[keep], n_words[keep], low[keep], high[keep], repeats

    def _combine(self, text, key, start, n_words, low, high) -> tuple[np.ndarray, list]:
        """Keep the earliest of equal strings; the others repeat it and need not travel."""
        look = _prints(text, low, high)
        order = np.argsort(look, kind="stable")
        same = look[order][1:] == look[order][:-1]
        many = np.zeros(len(look), dtype=bool)
        many[order[1:][same]] = many[order[:-1][same]] = True
        keep, repeats = np.ones(len(look), dtype=bool), []
        here: dict[bytes, tuple[int, int, int, int]] = {}
        for i in np.flatnonzero(many):
            string, place = text[low[i] : high[i]].tobytes(), (*key[i].tolist(), int(start[i]))
            if string in self.known and self.known[string] < place:
                keep[i] = False
                repeats.append((*place, place[-1] + int(n_words[i])))
                continue
            if string in here:
                other = here[string]
                if other[:-1] == place:
                    continue
                late, early = (i, other) if other[:-1] < place else (other[-1], (*place, i))
                keep[late] = False
                repeats.append((*key[late].tolist(), int(start[late]), int(start[late] + n_words[late])))
                here[string] = early
            else:
                here[string] = (*place, i)
        if len(self.known) > KNOWN_STRINGS:
            self.known.clear()
        for string, place in here.items():
            if place[:-1] < self.known.get(string, (2**63,)):
                self.known[string] = place[:-1]
        return keep, repeats


def _prints(text: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A quick fingerprint of byte ranges, for a first look: length and a few 8-byte parts."""
    padded = np.r_[text, np.zeros(8, np.uint8)]
    size = high - low
    out = size.astype(np.uint64)
    for eighth in range(8):
        at = low + size * eighth // 8
        part = np.zeros(len(low), dtype=np.uint64)
        for b in range(8):
            part |= padded[np.minimum(at + b, high - 1)].astype(np.uint64) << np.uint64(8 * b)
        out = mix64(out ^ part)
    return out


def repeated_in_bucket(
    window: int, key: np.ndarray, start: np.ndarray, n_words: np.ndarray, text: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first word, word after the last) of the stretches whose windows occur earlier.

    ``text`` holds the packed strings one after the other, a space behind each word.
    """
    none = (np.zeros(0, np.int64),) * 3
    if not len(key):
        return none
    ends = np.flatnonzero(text == 32)
    starts = np.r_[0, ends[:-1] + 1]
    head = np.cumsum(n_words) - n_words
    looks = _rolled(hash_words(text, starts, ends), window)
    at = _ranges(head, n_words - window + 1)
    owner = np.repeat(np.arange(len(key)), n_words - window + 1)
    look = looks[at]
    order = np.argsort(look)
    sorted_look = look[order]
    same = np.r_[False, sorted_look[1:] == sorted_look[:-1]]
    member = same | np.r_[same[1:], False]
    if not member.any():
        return none
    picked = order[member]
    where = start[owner[picked]] + at[picked] - head[owner[picked]]
    fine = np.lexsort((where, key[owner[picked]], look[picked]))
    picked, where = picked[fine], where[fine]
    group_head = np.r_[True, look[picked][1:] != look[picked][:-1]]
    lead = np.flatnonzero(group_head)[np.cumsum(group_head) - 1]
    names = key[owner[picked]]
    later = (names != names[lead]) | (where != where[lead])
    # Neighbouring windows mostly repeat neighbouring windows: compare such stretches at once.
    mine, theirs = at[picked[later]], at[picked[lead[later]]]
    by_place = np.argsort(mine)
    mine, theirs = mine[by_place], theirs[by_place]
    ours = owner[picked[later]][by_place]
    led = owner[picked[lead[later]]][by_place]
    new = np.r_[True, (np.diff(mine) != 1) | (np.diff(theirs) != 1) | (ours[1:] != ours[:-1]) | (led[1:] != led[:-1])] \
        if len(mine) else np.zeros(0, bool)
    a = np.flatnonzero(new)
    b = np.r_[a[1:], len(mine)] - 1 if len(a) else a
    equal = _equal_ranges(text, starts[mine[a]], ends[mine[b] + window - 1], starts[theirs[a]], ends[theirs[b] + window - 1])
    flagged = np.zeros(len(starts), dtype=bool)
    flagged[mine[np.repeat(equal, b - a + 1)]] = True
    if not equal.all():  # equal hashes of different words: settle those groups by their strings
        wrong = np.unique(looks[mine[~np.repeat(equal, b - a + 1)]])
        for value in wrong:
            firsts: dict[bytes, tuple[int, int]] = {}
            for i in picked[look[picked] == value]:  # in order of key and place
                w = at[i]
                string = text[starts[w] : ends[w + window - 1]].tobytes()
                place = (int(key[owner[i]]), int(start[owner[i]] + w - head[owner[i]]))
                flagged[w] = firsts.setdefault(string, place) != place
    hit = np.flatnonzero(flagged)
    who = np.searchsorted(head, hit, side="right") - 1
    cut = np.r_[True, (np.diff(hit) != 1) | (who[1:] != who[:-1])]
    a = np.flatnonzero(cut)
    b = np.r_[a[1:], len(hit)] - 1
    base = start[who[a]] - head[who[a]]
    return key[who[a]], hit[a] + base, hit[b] + base + window


def _equal_ranges(text, a_low, a_high, b_low, b_high, step: int = 1 << 22) -> np.ndarray:
    """Whether pairs of byte ranges are equal."""
    sizes = a_high - a_low
    out = sizes == b_high - b_low
    rows = np.flatnonzero(out)
    ends = np.cumsum(sizes[rows])
    at = 0
    while at < len(rows):
        to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, side="right")), at + 1)
        part = rows[at:to]
        n = sizes[part]
        differ = text[_ranges(a_low[part], n)] != text[_ranges(b_low[part], n)]
        out[part] = np.add.reduceat(differ, np.cumsum(n) - n) == 0
        at = to
    return out


def _hot_cells(docs: DataFrame, text_bytes: int) -> np.ndarray:
    """Which cells of a hash table hold far more short word runs than others, over all texts.

    The table has a cell for 64 KB of text, so a run below the limit cannot fill a bucket;
    it is a bit array of bounded size. It only orders the runs; results do not depend on it.
    """
    bits = int(np.clip(np.ceil(np.log2(max(text_bytes, 1) / 65_536)), 10, 22))
    shift = np.uint64(64 - bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            for _, _, raw, offsets in text_slices(batch.column(0)):
                starts, ends, first = find_words(raw, offsets)
                if len(starts) < RUN_WORDS:
                    continue
                grams = _rolled(hash_words(raw, starts, ends), RUN_WORDS)
                inside = _ranges(first[:-1], np.maximum(np.diff(first) - RUN_WORDS + 1, 0))
                cells += np.bincount((grams[inside] >> shift).astype(np.int64), minlength=len(cells))
        found = np.flatnonzero(cells)
        for lo in range(0, len(found), 1 << 16):
            part = found[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(cells[part])], names=["cell", "n"])

    counts = docs.select("_text").mapInArrow(trimmed(count), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    # At most one cell in HOT_FACTOR can exceed the limit, and there are 2 ** 22 at most.
    counts = cut(counts)
    mean = (counts.agg(F.sum("n")).first()[0] or 0) / (1 << bits)
    hot = np.zeros(1 << bits, dtype=bool)
    for row in counts.filter(F.col("n") > HOT_FACTOR * max(mean, 1024)).select("cell").toLocalIterator():
        hot[row[0]] = True
    return hot


def _pack_block(parts: list[tuple]) -> bytes:
    import zstandard

    key, start, words, text = (np.concatenate(c) for c in zip(*parts))
    head = np.array([len(key)], np.int64).tobytes()
    body = head + key.tobytes() + start.astype(np.int32).tobytes() + words.astype(np.int32).tobytes() + text.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(body)


def _open_blocks(blocks: list[bytes]) -> tuple[np.ndarray, ...]:
    import zstandard

    parts = []
    for block in blocks:
        body = zstandard.ZstdDecompressor().decompress(block)
        n = int(np.frombuffer(body, np.int64, 1)[0])
        parts.append(
            (
                np.frombuffer(body, np.int64, 2 * n, 8).reshape(n, 2),
                np.frombuffer(body, np.int32, n, 8 + 16 * n).astype(np.int64),
                np.frombuffer(body, np.int32, n, 8 + 20 * n).astype(np.int64),
                np.frombuffer(body, np.uint8, -1, 8 + 24 * n),
            )
        )
    return tuple(np.concatenate(c) for c in zip(*parts))


def _row_names(docs: DataFrame, key: str, text: str) -> tuple[Column, Column]:
    """What names a row: its key, and where keys repeat a hash of its text (else 0)."""
    name = F.coalesce(F.col(key).cast("long"), F.lit(_NULL_KEY))
    repeats = not docs.groupBy(name.alias("_key")).count().filter(F.col("count") > 1).isEmpty()
    look = F.xxhash64(F.coalesce(F.col(text), F.lit(""))) if repeats else F.lit(0).cast("long")
    return name.alias("_key"), look.alias("_look")


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of two numbers in order, and the place of each row among them."""
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    new = np.r_[True, (keys[order][1:] != keys[order][:-1]).any(axis=1)]
    place = np.empty(len(keys), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return keys[order][new], place


def _shares(found: np.ndarray, shares: int) -> pa.Table:
    """Stretches (rows of four numbers) packed by the share that their document belongs to."""
    name = mix64(found[:, 0].astype(np.uint64)) ^ found[:, 1].astype(np.uint64)
    share = (mix64(name) % np.uint64(shares)).astype(np.int32)
    order = np.argsort(share, kind="stable")
    ids, heads = np.unique(share[order], return_index=True)
    data = [part.tobytes() for part in np.split(found[order], heads[1:])] if len(ids) else []
    return pa.table({"_share": pa.array(ids, pa.int32()), "_data": pa.array(data, pa.binary())})


def _by_document(found: np.ndarray) -> pa.Table:
    """One row per document: its stretches in order, those that touch or overlap as one."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    ends = found[:, 3].copy()
    new = np.r_[True, (found[1:, :2] != found[:-1, :2]).any(axis=1)] if len(found) else np.zeros(0, bool)
    document = np.cumsum(new)
    # The furthest end so far within the document: ends are raised by the document's number.
    step = int(ends.max()) + 1 if len(found) else 1
    reach = np.maximum.accumulate(ends + document * step) - document * step
    fresh = new.copy()
    fresh[1:] |= found[1:, 2] > reach[:-1]
    heads = np.flatnonzero(fresh)
    lasts = np.r_[heads[1:], len(found)] - 1 if len(heads) else heads
    offsets = pa.array(np.r_[np.flatnonzero(new[heads]), len(heads)], pa.int32())
    first = found[new]
    return pa.table(
        {
            "_key": pa.array(first[:, 0]),
            "_look": pa.array(first[:, 1]),
            "_from": pa.ListArray.from_arrays(offsets, pa.array(found[heads, 2])),
            "_to": pa.ListArray.from_arrays(offsets, pa.array(reach[lasts])),
        }
    )


def repeated_spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = 20) -> DataFrame:
    """(_key, _look, _from, _to): one row per document with word stretches all of whose windows
    occur earlier in the corpus, as arrays of first words and of words after the last.

    Earlier means in a smaller key, in an equal key with a text of smaller hash, or at an
    earlier word of the same text. A document's stretches come in order and apart. A null
    key counts as the smallest. Documents without stretches have no row.
    """
    given = docs.select(*_row_names(docs, key, text), F.col(text).alias("_text"))
    size = given.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    hot = _hot_cells(given, size)
    buckets = max(1, int(np.ceil(size * 3.2 / BUCKET_BYTES)))
    shares = max(1, int(np.ceil(size / SHARE_BYTES)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, hot, buckets)
        waiting: dict[int, list] = {}
        repeats: list = []
        held, turn = 0, 0

        def written() -> Iterator[pa.RecordBatch]:
            rows = [(b, False, _pack_block(parts)) for b, parts in waiting.items()]
            if repeats:
                data = np.array(repeats, dtype=np.int64)
                rows.append((turn % buckets, True, data.tobytes()))
            for lo in range(0, len(rows), 64):
                part = rows[lo : lo + 64]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*part), (pa.int32(), pa.bool_(), pa.binary()))],
                    names=["_bucket", "_done", "_data"],
                )

        for batch in batches:
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            for lo, hi, raw, offsets in text_slices(batch.column(2)):
                packed = packer.pack(keys[lo:hi], raw, offsets)
                if packed is None:
                    continue
                words, bucket, name, start, n_words, low, high, more = packed
                repeats += more
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(order) else []
                for a, b in zip(cuts, np.r_[cuts[1:], len(order)].astype(int) if len(order) else []):
                    chosen = order[a:b]
                    string = words[_ranges(low[chosen], high[chosen] - low[chosen])]
                    waiting.setdefault(int(bucket[chosen[0]]), []).append(
                        (name[chosen], start[chosen], n_words[chosen], string)
                    )
                    held += len(string) + 24 * len(chosen)
                if held > FLUSH_BYTES or len(repeats) > 500_000:
                    turn += 1
                    yield from written()
                    waiting, repeats, held = {}, [], 0
        if waiting or repeats:
            yield from written()

    def settle(table: pa.Table) -> pa.Table:
        done = table.column("_done").to_pylist()
        data = table.column("_data").to_pylist()
        parts = [np.frombuffer(d, np.int64).reshape(-1, 4) for d, f in zip(data, done) if f]
        blocks = [d for d, f in zip(data, done) if not f]
        del data
        if blocks:
            keys, *strings = _open_blocks(blocks)
            names, place = _ranked(keys)
            at, begins, ends = repeated_in_bucket(window, place, *strings)
            parts.append(np.column_stack([names[at], begins, ends]))
        packed = _shares(np.concatenate(parts) if parts else np.zeros((0, 4), np.int64), shares)
        parts, blocks, keys, strings, names, place = (None,) * 6
        give_back()
        return packed

    def gather(table: pa.Table) -> pa.Table:
        found = np.concatenate([np.frombuffer(d, np.int64) for d in table.column("_data").to_pylist()])
        return _by_document(found.reshape(-1, 4))

    blocks = given.mapInArrow(trimmed(pack), "_bucket int, _done boolean, _data binary")
    packed = blocks.groupBy("_bucket").applyInArrow(settle, "_share int, _data binary")
    return packed.groupBy("_share").applyInArrow(
        gather, "_key long, _look long, _from array<long>, _to array<long>"
    )


def _applied(docs: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """(_row, n_words, n_removed, kept_text): each row as a struct, and what is left of its text."""
    spans = repeated_spans(docs, key=key, text=text, window=window)
    given = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        *_row_names(docs, key, text),
    )
    joined = given.join(spans, ["_key", "_look"], "left").select("_row", "_from", "_to")
    place = docs.columns.index(text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = part.column(0).flatten()[place].to_pylist()
                n, gone, kept = [], [], []
                for t, begins, ends in zip(texts, part.column(1).to_pylist(), part.column(2).to_pylist()):
                    words = (t or "").encode("utf-8", "surrogatepass").split()
                    n.append(len(words))
                    if begins:
                        marks = np.zeros(len(words) + 1, dtype=np.int64)
                        np.add.at(marks, np.minimum(begins, len(words)), 1)
                        np.add.at(marks, np.minimum(ends, len(words)), -1)
                        stay = np.cumsum(marks[:-1]) == 0
                        words = [w for w, s in zip(words, stay) if s]
                    gone.append(n[-1] - len(words))
                    kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                    names=["_row", "n_words", "n_removed", "kept_text"],
                )

    schema = T.StructType(
        [
            T.StructField("_row", joined.schema["_row"].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("kept_text", T.StringType()),
        ]
    )
    return joined.mapInArrow(trimmed(apply), schema)


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = 20) -> DataFrame:
    """Remove every word that lies in a window of ``window`` words occurring earlier.

    Returns key, n_words, n_removed and kept_text (the kept words joined by one space).
    Words are runs other than space and 0x09-0x0D, taken unchanged from whole texts; windows
    are judged on the input. A null or empty text has no words and kept_text ''. Texts
    shorter than a window lose nothing. Rows with equal keys come in the order of a hash of
    their texts; those of equal texts too are one document, and lose the same places. Other
    columns are ignored.
    """
    applied = _applied(docs.select(key, text), key, text, window)
    return applied.select(F.col(f"_row.`{key}`").alias(key), "n_words", "n_removed", "kept_text")


def without_repeats(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: str = "n_chars", window: int = 20
) -> DataFrame:
    """All rows and columns; a text that loses words becomes its kept words.

    Texts that lose nothing stay as they are, null ones too. Where a text changes, column
    ``size`` (if there is one) becomes its number of characters. A text that is all
    repetition becomes empty.
    """
    changed = F.col("n_removed") > 0
    columns = []
    for name, kind in docs.dtypes:
        value = F.col(f"_row.`{name}`")
        if name == text:
            value = F.when(changed, F.col("kept_text")).otherwise(value)
        elif name == size:
            value = F.when(changed, F.length("kept_text").cast(kind)).otherwise(value)
        columns.append(value.alias(name))
    return _applied(docs, key, text, window).select(*columns)
