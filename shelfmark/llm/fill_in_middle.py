"""Fill-in-the-middle texts by rotating blocks in place, and back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import find_words, text_slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"


def exchange(block: bytearray, start: int, border: int, end: int) -> None:
    """Swap the neighbours ``[start, border)`` and ``[border, end)`` inside ``block``.

    Three reversals: each neighbour on its own, then both together.
    """
    view = np.frombuffer(block, dtype=np.uint8)
    view[start:border] = view[start:border][::-1]
    view[border:end] = view[border:end][::-1]
    view[start:end] = view[start:end][::-1]


def rearrange(text: bytes, first: int, second: int, form: str) -> bytearray:
    """The text with sentinels, cut at two byte offsets, its blocks in the order of ``form``."""
    block = bytearray(text)
    if form == "plain":
        return block
    block[second:second] = SUFFIX
    block[first:first] = MIDDLE
    block[0:0] = PREFIX
    middle, suffix = first + 3, second + 6
    exchange(block, middle, suffix, len(block))
    if form == "spm":
        exchange(block, 0, middle, middle + len(block) - suffix)
    return block


def restore(output: bytes, form: str) -> bytearray:
    """The exact text of an output of ``rearrange``: the rotations undone, sentinels taken out.

    No text with a sentinel in it is ever rearranged and a sentinel cannot arise across a
    cut, so each is found once.
    """
    block = bytearray(output)
    if form == "plain":
        return block
    if form == "spm":
        exchange(block, 0, block.index(PREFIX), block.index(MIDDLE))
    suffix, middle = block.index(SUFFIX), block.index(MIDDLE)
    exchange(block, suffix, middle, len(block))
    middle, suffix = block.index(MIDDLE), block.index(SUFFIX)
    del block[suffix : suffix + 3], block[middle : middle + 3], block[0:3]
    return block


def draws(key: object, seed: int) -> list[int]:
    """Four 32-bit numbers that depend on the key alone; a null key counts as an empty name."""
    name = f"{seed}:{'' if key is None else key}"
    digest = hashlib.sha256(name.encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def _unit_ends(ends: np.ndarray, start: int, end: int) -> np.ndarray:
    """Where the units of the text at ``[start, end)`` end: words with the blanks before them, then blanks."""
    return ends if end == start or (len(ends) and ends[-1] == end) else np.append(ends, end)


def _characters(raw: np.ndarray) -> int:
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


def fill_in_middle(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    seed: int = 42,
    plain_percent: int = 50,
    spm_percent: int = 80,
) -> DataFrame:
    """Texts rearranged for infilling: key, n, form, prefix_chars, middle_chars, output.

    A text is cut into units (a word with the blanks before it; blanks at the end are one
    unit). Two cuts between units, the form and its order come from a hash of seed and key,
    so a rerun or a lost executor gives the same rows, and equal keys the same draws. A
    ``psm`` output is ``<P>prefix<S>suffix<M>middle``, ``spm`` puts the suffix first. Null or
    empty texts and texts that hold a sentinel stay ``plain``; so do ``plain_percent`` of the
    others, the two lengths being null there. A null text counts as empty, a null key as an
    empty name. One row per row, in the scan stage, without a shuffle; a task holds one text
    and one Arrow batch. Other columns are neither read nor returned.
    """
    schema = T.StructType(
        [
            docs.schema[key],
            T.StructField("n", T.LongType()),
            T.StructField("form", T.StringType()),
            T.StructField("prefix_chars", T.LongType()),
            T.StructField("middle_chars", T.LongType()),
            T.StructField("output", T.StringType()),
        ]
    )

    def one(raw: np.ndarray, ends: np.ndarray, start: int, end: int, name: object) -> tuple:
        body = raw[start:end].tobytes()
        units = _unit_ends(ends, start, end)
        n = len(units)
        h1, h2, h3, h4 = draws(name, seed)
        if not body or any(s in body for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= plain_percent:
            return n, "plain", None, None, body
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        first = int(units[low - 1]) - start if low else 0
        second = int(units[high - 1]) - start if high else 0
        form = "spm" if h4 % 100 < spm_percent else "psm"
        prefix, middle = _characters(raw[start : start + first]), _characters(raw[start + first : start + second])
        return n, form, prefix, middle, bytes(rearrange(body, first, second, form))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in text_slices(batch.column(1)):
                _, ends, first = find_words(raw, offsets)
                names = batch.column(0).slice(lo, hi - lo)
                made = [
                    one(raw, ends[first[i] : first[i + 1]], int(offsets[i]), int(offsets[i + 1]), name)
                    for i, name in enumerate(names.to_pylist())
                ]
                n, form, prefix, middle, output = zip(*made)
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                     pa.array(middle, pa.int64()), pa.array(output, pa.binary()).view(pa.string())],
                    names=[key, "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return docs.select(key, text).mapInArrow(run, schema)


def restore_texts(made: DataFrame, *, output: str = "output", form: str = "form", to: str = "restored") -> DataFrame:
    """All rows of ``made`` with the exact text rebuilt from output and form as column ``to``.

    A null output gives null. A row whose form is not ``psm`` or ``spm`` is taken as plain.
    ``to`` must not be a column of ``made`` already.
    """
    schema = T.StructType([*made.schema.fields, T.StructField(to, T.StringType())])
    names = made.columns
    at_output, at_form = names.index(output), names.index(form)

    def back(value: bytes | None, kind: str | None) -> bytes | None:
        return None if value is None else bytes(restore(value, kind if kind in ("psm", "spm") else "plain"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                values = part.column(at_output).cast(pa.binary()).to_pylist()
                texts = list(map(back, values, part.column(at_form).to_pylist()))
                columns = [*part.columns, pa.array(texts, pa.binary()).view(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, to])

    return made.mapInArrow(run, schema)


def digests(made: DataFrame) -> DataFrame:
    """The digest columns of rearranged and restored texts; the texts themselves are left out."""
    whole = restore_texts(made)
    return whole.select(
        *[c for c in made.columns if c != "output"],
        F.sha2(F.col("output"), 256).alias("output_sha256"),
        F.sha2(F.col("restored"), 256).alias("restored_sha256"),
    )
