"""Alignment of two tokenizers over a corpus, each distinct text once."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import stored
from .token_counts import byte_letters

# A single space between two other characters: no token of either vocabulary goes across it.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_B_SPACE = "▁"
# Id pairs that are broadcast at most (24 bytes each); rarer ones are joined by a shuffle.
HEAD_PAIRS = 1_000_000
# Texts that make up at least one in so many rows are joined by broadcast: at most so many texts.
HEAVY_TEXTS = 1_000


class ByteLevelEncoder:
    """Ids and token bytes of a byte-level BPE file; special strings are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # A task has one core; the library would start a thread for each core of the machine.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        letters = byte_letters()
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.tokens = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            self.tokens[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()

    def encode(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids


class PieceEncoder:
    """Ids and token bytes of a sentencepiece model, which puts a space before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self.tokens = [
            bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace(_B_SPACE, " ").encode()
            for p in pieces
        ]
        # No piece has a space after another character, so texts may be cut before a space.
        self.cuts_before_space = not any(_B_SPACE in p.lstrip(_B_SPACE) for p in pieces)

    def encode(self, text: str) -> list[int]:
        return self.library.encode(text)


class Aligned(NamedTuple):
    """Aligned stretches: links of all in one array, the others a value per stretch."""

    links: np.ndarray
    n_links: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    shown: list[str]


class Aligner:
    """Aligns whole texts; keeps the stretches it has met, up to a bound of bytes.

    A text is cut at single spaces, which no token of either side crosses. Stretches not met
    before are encoded many at a time, as one text joined by spaces.
    """

    def __init__(
        self, vocabulary: str, model: str, kept_bytes: int = 96 << 20, chunk: int = 20_000, joined_chars: int = 1 << 16
    ):
        self.a, self.b = ByteLevelEncoder(vocabulary), PieceEncoder(model)
        self.width = len(self.b.tokens)
        self.sizes_a = np.array([len(t) for t in self.a.tokens], dtype=np.int64)
        self.sizes_b = np.array([len(t) for t in self.b.tokens], dtype=np.int64)
        self.names = [str(i) for i in range(max(len(self.a.tokens), len(self.b.tokens)))]
        self.kept_bytes, self.chunk, self.joined_chars = kept_bytes, chunk, joined_chars
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.shown: list[str] = []
        self.facts = np.zeros((1024, 5), dtype=np.int64)  # n_a, n_b, n_groups, n_links, first link
        self.links = np.zeros(1 << 16, dtype=np.int64)
        self.n_links = self.held = 0

    def encode(self, stretches: list[str]) -> Aligned | None:
        """The stretches, each with a space before it, as one text; None where bytes differ from it.

        Between two neighbouring token ends lies a part of exactly one token of each side, and
        two tokens that overlap share exactly one such part: the parts are the links.
        """
        text = " ".join(stretches)
        a, b = self.a.encode(" " + text), self.b.encode(text)
        wanted = (" " + text).encode()
        if b"".join([self.a.tokens[i] for i in a]) != wanted or b"".join([self.b.tokens[i] for i in b]) != wanted:
            return None
        ids_a, ids_b = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        ends_a, ends_b = np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b])
        ends, common = np.union1d(ends_a, ends_b), np.intersect1d(ends_a, ends_b, assume_unique=True)
        links = ids_a[np.searchsorted(ends_a, ends)] * self.width + ids_b[np.searchsorted(ends_b, ends)]
        borders = np.cumsum([len(s.encode()) + 1 for s in stretches])
        cut_a, cut_b, cut_links, cut_groups = (
            np.searchsorted(e, borders, side="right") for e in (ends_a, ends_b, ends, common)
        )
        # The ids as they are shown: group by group, those of A before those of B.
        side = np.r_[2 * np.searchsorted(common, ends_a), 2 * np.searchsorted(common, ends_b) + 1]
        order = np.argsort(side, kind="stable")
        side, ids = side[order], np.r_[ids_a, ids_b][order]
        mark = np.where(side[1:] == side[:-1], ",", np.where(side[:-1] % 2 == 0, "|", ";"))
        flat = [""] * (2 * len(ids))
        flat[0::2] = [self.names[i] for i in ids.tolist()]
        flat[1:-1:2] = mark.tolist()
        cut_ids = [0, *(2 * (cut_a + cut_b)).tolist()]
        shown = ["".join(flat[lo : hi - 1]) for lo, hi in zip(cut_ids, cut_ids[1:])]
        sizes = [np.diff(c, prepend=0) for c in (cut_links, cut_a, cut_b, cut_groups)]
        return Aligned(links, *sizes, shown)

    def _keep(self, stretches: list[str], found: Aligned) -> None:
        at, to = len(self.shown), len(self.shown) + len(stretches)
        while to > len(self.facts):
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)])
        while self.n_links + len(found.links) > len(self.links):
            self.links = np.concatenate([self.links, np.zeros_like(self.links)])
        first = self.n_links + np.cumsum(found.n_links) - found.n_links
        self.facts[at:to] = np.stack([found.n_a, found.n_b, found.n_groups, found.n_links, first], axis=1)
        self.links[self.n_links : self.n_links + len(found.links)] = found.links
        self.n_links += len(found.links)
        self.shown += found.shown
        self.place.update(zip(stretches, range(at, to)))
        self.held += 8 * len(found.links) + sum(300 + len(t) + 2 * len(s) for s, t in zip(stretches, found.shown))

    def _learn(self, stretches: list[str]) -> None:
        """Give every stretch a place; a stretch that its tokens do not spell has place -1."""
        if self.held > self.kept_bytes:
            self._forget()
        waiting, chars = [], 0
        for s in set(stretches).difference(self.place):
            if s and not s[0].isspace() and not s[-1].isspace():
                waiting.append(s)
                chars += len(s)
                if chars > self.joined_chars:
                    self._learn_joined(waiting)
                    waiting, chars = [], 0
            else:
                self._learn_joined([s])
        if waiting:
            self._learn_joined(waiting)

    def _learn_joined(self, stretches: list[str]) -> None:
        found = self.encode(stretches)
        if found is not None:
            self._keep(stretches, found)
        elif len(stretches) > 1:
            half = len(stretches) // 2
            self._learn_joined(stretches[:half])
            self._learn_joined(stretches[half:])
        else:
            self.place[stretches[0]] = -1
            self.held += 300 + 2 * len(stretches[0])

    def align_all(self, texts: list[str | None]) -> list[tuple | None]:
        """Each text as by ``align``; the new stretches of neighbouring texts are encoded together."""
        out: list[tuple | None] = []
        waiting: list[list[str]] = []

        def finish() -> None:
            if len(waiting) > 1:
                self._learn([s for stretches in waiting for s in stretches])
            out.extend(self._align(stretches) if stretches else None for stretches in waiting)
            waiting.clear()

        for text in texts:
            waiting.append([] if not text else _CUT.split(text) if self.b.cuts_before_space else [text])
            if sum(map(len, waiting)) > self.chunk:
                finish()
        finish()
        return out

    def align(self, text: str) -> tuple | None:
        return self.align_all([text])[0]

    def _align(self, stretches: list[str]) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray] | None:
        """(n_a, n_b, n_groups, n_links, digest, linked id pairs, their counts) of a text, or None."""
        digest = hashlib.sha256()
        totals = np.zeros(4, dtype=np.int64)
        links: list[np.ndarray] = []
        for lo in range(0, len(stretches), self.chunk):
            part = stretches[lo : lo + self.chunk]
            places = list(map(self.place.get, part))
            if None in places:
                self._learn(part)
                places = [self.place[s] for s in part]
            if -1 in places:
                return self._whole(" ".join(stretches)) if len(stretches) > 1 else None
            digest.update(((";" if lo else "") + ";".join([self.shown[i] for i in places])).encode())
            facts = self.facts[places]
            totals += facts[:, :4].sum(axis=0)
            sizes = facts[:, 3]
            inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            links.append(self.links[inner + np.repeat(facts[:, 4], sizes)])
        pairs, times = np.unique(np.concatenate(links), return_counts=True)
        return (*totals.tolist(), digest.hexdigest(), pairs, times)

    def _whole(self, text: str) -> tuple | None:
        """A stretch differs: only if the joined bytes of the whole still agree are there tokens."""
        found = self.encode([text])
        if found is None:
            return None
        pairs, times = np.unique(found.links, return_counts=True)
        numbers = [int(n[0]) for n in (found.n_a, found.n_b, found.n_groups, found.n_links)]
        return (*numbers, hashlib.sha256(found.shown[0].encode()).hexdigest(), pairs, times)


_MEASURES = ["n_a", "n_b", "n_groups", "n_links"]
_ALIGNED = T.StructType(
    [
        T.StructField("digest", T.BinaryType()),
        *[T.StructField(name, T.LongType()) for name in ["copies", *_MEASURES]],
        T.StructField("groups_sha256", T.StringType()),
        *[T.StructField(name, T.ArrayType(T.LongType())) for name in ("pairs", "times")],
    ]
)


def align_texts(docs: DataFrame, vocabulary: str, model: str, *, text: str = "text") -> DataFrame:
    """One row per distinct non-null text, tokenised and aligned once.

    Columns: digest (SHA-256 of the text), copies (rows that have it), n_a, n_b, n_groups,
    n_links, groups_sha256, and the linked id pairs of the text (a * size of B + b) with the
    number of links of each. The rows are brought together by the full text, copies being
    counted on the map side, so no text with many copies gathers in a task. A text that is
    empty or whose tokens do not spell it has zeros, an empty string and no pairs.
    """
    distinct = docs.select(F.col(text).alias("text")).filter(F.col("text").isNotNull()).groupBy("text").agg(
        F.count(F.lit(1)).alias("copies")
    )
    keyed = distinct.select("text", F.unhex(F.sha2("text", 256)).alias("digest"), "copies")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(vocabulary, model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                found = aligner.align_all(part.column(0).to_pylist())
                found = [f or (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)) for f in found]
                *numbers, digests, pairs, times = zip(*found)
                ends = np.cumsum([0, *map(len, pairs)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(1), part.column(2), *(pa.array(n, pa.int64()) for n in numbers),
                        pa.array(digests, pa.string()),
                        *(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), pa.int64())) for x in (pairs, times)),
                    ],
                    names=_ALIGNED.names,
                )

    return keyed.mapInArrow(run, _ALIGNED)


def _links(aligned: DataFrame) -> DataFrame:
    """A row per distinct text and linked id pair: digest, pair, times, copies."""
    return aligned.select("digest", "copies", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select(
        "digest", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"), "copies"
    )


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """How many links of the whole corpus hold each id pair: pair, a, b, n, best.

    A text's links weigh as often as it has copies. ``best`` marks the pairs with the highest
    count of their B id, ties included. Counts are combined on the map side; no more rows per
    task are shuffled than it has different pairs.
    """
    counts = _links(aligned).groupBy("pair").agg(F.sum(F.col("times") * F.col("copies")).alias("n"))
    counts = counts.select(
        "pair", F.expr(f"pair div {width}").alias("a"), F.expr(f"pair % {width}").alias("b"), "n"
    )
    counts = stored(counts, "pair-counts")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _scores(aligned: DataFrame, pairs: DataFrame, head_pairs: int) -> DataFrame:
    """n_best and count_sum of each distinct text.

    The most frequent pairs, a bounded number that covers nearly all links, are broadcast;
    the links of rarer pairs are shuffled to their counts, where no pair is hot.
    """
    value = pairs.select("pair", F.when(F.col("best"), F.lit(1)).otherwise(F.lit(0)).alias("best"), "n")
    kept = stored(value, "pair-values")
    links = _links(aligned)
    totals = [F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    if kept.count() <= head_pairs:
        return links.join(F.broadcast(kept), "pair").groupBy("digest").agg(*totals)
    head = stored(kept.orderBy(F.desc("n"), "pair").limit(head_pairs), "pair-head")
    often = links.join(F.broadcast(head), "pair").groupBy("digest").agg(*totals)
    rare = links.join(F.broadcast(head.select("pair")), "pair", "left_anti")
    tail = kept.join(head.select("pair"), "pair", "left_anti")
    rarely = rare.join(tail, "pair").groupBy("digest").agg(*totals)
    return often.unionByName(rarely).groupBy("digest").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")
    )


def align_tokenizers(
    docs: DataFrame,
    vocabulary: str,
    model: str,
    *,
    key: str = "doc_id",
    text: str = "text",
    head_pairs: int = HEAD_PAIRS,
    heavy_texts: int = HEAVY_TEXTS,
) -> DataFrame:
    """How well two tokenizers fit each other on every document, one row per row of ``docs``.

    Columns: key, n_a, n_b (tokens), n_groups (stretches that begin and end with tokens of
    both), n_links (overlapping pairs of tokens), n_best (links whose id pair is the most
    frequent of its B id in the corpus), count_sum (sum of the links' corpus counts) and
    groups_sha256. A is a byte-level BPE file and encodes a space and the text, B a
    sentencepiece model that adds the space. A null or empty text, and one that a side's
    tokens do not spell, has zeros and an empty digest. Copies and repeated or null keys are
    rows of their own; other columns are not read; an empty table gives no rows.

    Measures are joined back by the text's digest. A text that makes up a part of
    1/``heavy_texts`` of the rows is joined by broadcast, so no task gets its copies.
    """
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=model).get_piece_size()
    aligned = stored(align_texts(docs, vocabulary, model, text=text), "aligned-texts")
    pairs = pair_counts(aligned, width)
    names = [*_MEASURES, "n_best", "count_sum"]
    scores = _scores(aligned, pairs, head_pairs)
    measures = aligned.drop("pairs", "times").join(scores, "digest", "left")
    measures = stored(
        measures.select(
            "digest", "copies", *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in names], "groups_sha256"
        ),
        "text-measures",
    )
    named = stored(
        docs.select(F.col(key).alias("_key"), F.unhex(F.sha2(F.col(text), 256)).alias("digest")), "text-digests"
    )
    rows = named.count()
    heavy = measures.filter(F.col("copies") * heavy_texts >= rows)
    light = measures.filter(F.col("copies") * heavy_texts < rows)
    known = named.filter(F.col("digest").isNotNull())
    found = known.join(F.broadcast(heavy), "digest").unionByName(
        known.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").join(light, "digest")
    )
    nothing = named.filter(F.col("digest").isNull()).select(
        "_key", *[F.lit(0).cast("long").alias(n) for n in names], F.lit("").alias("groups_sha256")
    )
    return found.select(*nothing.columns).unionByName(nothing).withColumnRenamed("_key", key)
