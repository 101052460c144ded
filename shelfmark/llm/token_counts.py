"""Token counts by rank-synchronous merging of byte-pair sequences held as ragged arrays."""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The pre-token pattern of the byte-level vocabulary.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_NONE = np.int32(2**31 - 1)
LONG_BYTES = 4_096  # longer sequences are merged with work only where a pair changes


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file, and the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class MergeTable:
    """Ranks and results of all merges, for lookups of many pairs at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.size = max(vocab.values()) + 1
        self.byte_ids = np.zeros(256, dtype=np.int64)
        for letter, byte in byte_letters().items():
            self.byte_ids[byte] = vocab[letter]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made
        self.special = [t["content"] for t in spec["added_tokens"]]
        # A first glance that most absent pairs fail: one bit for each hashed key.
        self.bits = 22
        self.seen = np.zeros(1 << self.bits, dtype=bool)
        self.seen[self._cell(keys)] = True

    def _cell(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.size + right
        out = np.full(len(keys), _NONE, dtype=np.int32)
        maybe = np.flatnonzero(self.seen[self._cell(keys)])
        if len(maybe):
            wanted = keys[maybe]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            out[maybe] = np.where(self.keys[at] == wanted, self.ranks[at], _NONE)
        return out


def merged_lengths(table: MergeTable, pieces: list[bytes]) -> np.ndarray:
    """How many symbols are left of each byte sequence after all merges.

    In each round every sequence applies its own lowest-ranked pair at all its places;
    sequences without a pair left drop out. A merged symbol only takes part in pairs of a
    higher rank, so a round per rank gives what one merge at a time gives.
    """
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    counts = sizes.copy()
    for i in np.flatnonzero(sizes > LONG_BYTES).tolist():
        counts[i] = merged_length(table, pieces[i])
    live = np.flatnonzero((sizes > 1) & (sizes <= LONG_BYTES))
    if not len(live):
        return counts
    symbols = table.byte_ids[np.frombuffer(b"".join(pieces[i] for i in live), dtype=np.uint8)]
    owner = np.repeat(np.arange(len(live)), sizes[live])
    names = live

    def ranks_at(places: np.ndarray) -> np.ndarray:
        out = np.full(len(places), _NONE, dtype=np.int32)
        ok = np.flatnonzero(places + 1 < len(symbols))
        ok = ok[owner[places[ok]] == owner[places[ok] + 1]]
        out[ok] = table.rank(symbols[places[ok]], symbols[places[ok] + 1])
        return out

    rank = ranks_at(np.arange(len(symbols)))
    while True:
        heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        lowest = np.minimum.reduceat(rank, heads)
        lengths = np.diff(np.r_[heads, len(symbols)])
        done = lowest == _NONE
        counts[names[done]] = lengths[done]
        if done.all():
            return counts
        if done.any():
            stay = np.repeat(~done, lengths)
            symbols, rank, names = symbols[stay], rank[stay], names[~done]
            lengths, lowest = lengths[~done], lowest[~done]
            owner = np.repeat(np.arange(len(names)), lengths)
        hit = np.flatnonzero(rank == np.repeat(lowest, lengths))
        # Of adjacent hits (a run of one symbol) every second one is taken, from the left.
        run = np.r_[True, np.diff(hit) != 1]
        nth = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
        hit = hit[nth % 2 == 0]
        symbols[hit] = table.made[rank[hit]]
        keep = np.ones(len(symbols), dtype=bool)
        keep[hit + 1] = False
        moved = np.cumsum(keep) - 1
        symbols, rank, owner, hit = symbols[keep], rank[keep], owner[keep], moved[hit]
        near = np.zeros(len(symbols), dtype=bool)
        near[hit] = True
        near[hit[hit > 0] - 1] = True
        touched = np.flatnonzero(near)
        rank[touched] = ranks_at(touched)


def merged_length(table: MergeTable, piece: bytes) -> int:
    """``merged_lengths`` of one long sequence, whose rounds are very many.

    The symbols are a linked list, and the places of each rank wait together, so a round
    touches the places of the lowest rank and their neighbours alone.
    """
    symbols = table.byte_ids[np.frombuffer(piece, dtype=np.uint8)]
    n = len(symbols)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[-1] = -1
    rank = np.append(table.rank(symbols[:-1], symbols[1:]), _NONE)
    waiting: dict[int, list[np.ndarray]] = {}
    lowest: list[int] = []

    def wait(places: np.ndarray) -> None:
        places = places[rank[places] != _NONE]
        places = places[np.argsort(rank[places], kind="stable")]
        ranks = rank[places]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(places)]):
            if lo < hi:
                r = int(ranks[lo])
                if r not in waiting:
                    waiting[r] = []
                    heappush(lowest, r)
                waiting[r].append(places[lo:hi])

    wait(np.arange(n))
    while lowest:
        r = heappop(lowest)
        hit = np.unique(np.concatenate(waiting.pop(r)))
        hit = hit[rank[hit] == r]  # places whose pair has changed wait elsewhere, or are gone
        if not len(hit):
            continue
        # Of hits that overlap (a run of one symbol) every second one is taken, from the left.
        run = np.r_[True, after[hit[:-1]] != hit[1:]]
        nth = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
        hit = hit[nth % 2 == 0]
        gone = after[hit]
        symbols[hit] = table.made[r]
        rank[gone] = _NONE
        n -= len(hit)
        follow = after[gone]
        after[hit] = follow
        linked = follow >= 0
        before[follow[linked]] = hit[linked]
        touched = np.unique(np.concatenate([hit, before[hit]]))
        touched = touched[touched >= 0]
        ends = after[touched]
        rank[touched] = np.where(ends >= 0, table.rank(symbols[touched], symbols[np.maximum(ends, 0)]), _NONE)
        wait(touched)
    return n


class TokenCounter:
    """Counts tokens of texts; keeps the lengths of pre-tokens it has met, up to a bound."""

    def __init__(self, path: str, kept: int = 400_000, text_chars: int = 1 << 20):
        import regex

        self.table = MergeTable(path)
        self.find = regex.compile(PRE_TOKENS)
        special = sorted(self.table.special, key=len, reverse=True)
        self.split = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.kept, self.text_chars = kept, text_chars
        self.lengths: dict[str, int] = {}

    def _learn(self, tokens: set[str]) -> None:
        if len(self.lengths) > self.kept:
            self.lengths.clear()
            unknown = list(tokens)
        else:
            unknown = list(tokens - self.lengths.keys())
        if unknown:
            pieces = [t.encode("utf-8", "surrogatepass") for t in unknown]
            self.lengths.update(zip(unknown, merged_lengths(self.table, pieces).tolist()))

    def _parts(self, text: str) -> tuple[list[str], int]:
        """The stretches between special strings, and how many of those there are."""
        if self.split is None or not any(s in text for s in self.table.special):
            return [text], 0
        parts = self.split.split(text)
        return parts, len(parts) - 1

    def _count_long(self, text: str) -> int:
        parts, total = self._parts(text)
        for part in parts:
            found = (m.group() for m in self.find.finditer(part))
            while chunk := list(islice(found, 100_000)):
                self._learn(set(chunk))
                total += sum(map(self.lengths.__getitem__, chunk))
        return total

    def count(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        at = 0
        while at < len(texts):
            waiting, chars = [], 0
            while at < len(texts) and chars < self.text_chars:
                text = texts[at]
                if len(text) > self.text_chars:
                    out[at] = self._count_long(text)
                elif text:
                    parts, out[at] = self._parts(text)
                    waiting.append((at, [t for p in parts for t in self.find.findall(p)]))
                    chars += len(text)
                at += 1
            self._learn(set().union(*(tokens for _, tokens in waiting)))
            for row, tokens in waiting:
                out[row] += sum(map(self.lengths.__getitem__, tokens))
        return out


def count_tokens(
    docs: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text", limit: int = 512
) -> DataFrame:
    """Bytes and tokens of every whole text: key, n_bytes, n_tokens, over_limit.

    ``vocabulary`` is the path of a byte-level BPE file that every executor can read. Only
    key and text are read, there is no shuffle, and a task holds one Arrow batch and a
    bounded table of known pre-tokens. A null text counts as empty (0 and 0). Rows with
    equal keys are counted each on their own, other columns are ignored.
    """
    schema = T.StructType(
        [
            docs.schema[key],
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(vocabulary)
        for batch in batches:
            sizes, counts = [], []
            for lo in range(0, batch.num_rows, 256):
                texts = [t or "" for t in batch.column(1).slice(lo, 256).to_pylist()]
                sizes += [len(t.encode("utf-8", "surrogatepass")) for t in texts]
                counts += counter.count(texts)
            n = np.array(counts, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(n), pa.array(n > limit)],
                names=[key, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(key, text).mapInArrow(run, schema)
