"""Near duplicates by a chosen-path similarity join over minwise sketches.

A document is known by the smallest hashes of its shingles under many orders. From the root
of a tree, a node picks one or two of these orders, and a document goes on to the child
named by its hash there; documents alike enough share a path with a fixed chance, others
hardly ever. Nodes of few documents are compared exhaustively, larger ones branch further,
and independent trees bring the chance of missing a pair below a target. Links are always
confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import counted, light, merge_roots, packed, with_root
from .storage import stored, trimmed
from .words import find_words, hash_words, lowered, mix64, text_slices

ORDERS = 128
TREES = 12  # at depth 5 a pair of similarity 0.8 shares a node of a tree with chance 0.52
DEPTH = 5
MORE = 3  # levels added when a node is too large
ROUNDS = 3
EXTRA = (5, 5, 4)  # trees added for large nodes in each round: deeper, a tree misses more pairs
SMALL_NODE = 64
CELL = 128  # documents of either side that meet in one piece of comparing work
CELL_ROWS = 10_000  # rows of such pieces that one task is given at least
ESTIMATE = 0.66  # four deviations below 0.8
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Each text's set of hashed shingles, sorted; A-Z count as a-z.

    A text of fewer words than a shingle has has one, the whole sequence; one without words
    has none.
    """
    raw = lowered(raw)
    starts, ends, first = find_words(raw, offsets)
    hashes = hash_words(raw, starts, ends)
    n = len(hashes)
    rolled = np.zeros(max(n - words + 1, 0), dtype=np.uint64)
    for i in range(words):
        rolled = mix64(rolled * _STEP + hashes[i : i + len(rolled)] + np.uint64(words))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            whole = np.zeros(1, dtype=np.uint64)
            for h in hashes[a:b]:
                whole = mix64(whole * _STEP + h + np.uint64(b - a))
            out.append(whole)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    factors = rng.integers(0, 2**32, ORDERS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    return factors, rng.integers(0, 2**32, ORDERS, dtype=np.uint64).astype(np.uint32)


def sketch(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Sixteen bits of the smallest hash under each order."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(ORDERS, 2**32 - 1, dtype=np.uint32)
    for lo in range(0, len(x), 2048):
        hashed = x[lo : lo + 2048, None] * factors + shifts
        np.minimum(least, hashed.min(axis=0), out=least)
    return ((least * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.uint16)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(_key, _name, _n, _set, _sketch) of (_key, _name, _text): set size, digest of the set, sketch."""
    factors, shifts = _multipliers()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in text_slices(batch.column(2)):
                sets = shingle_sets(raw, offsets, words)
                digests = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                made = [sketch(s, factors, shifts).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(1).slice(lo, hi - lo),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array(made, pa.binary()),
                    ],
                    names=["_key", "_name", "_n", "_set", "_sketch"],
                )

    return docs.mapInArrow(trimmed(run), "_key long, _name long, _n long, _set binary, _sketch binary")


def grow(nodes: np.ndarray, owners: np.ndarray, values: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes that documents reach some levels below the given ones.

    A node chooses one order, and every fourth node two, by its own hash alone; so it has
    1.25 children for a document on average, the inverse of the similarity sought.
    """
    for _ in range(levels):
        twice = np.flatnonzero(mix64(nodes + np.uint64(3)) & np.uint64(3) == 0)
        nodes = np.concatenate([nodes, nodes[twice]])
        owners = np.concatenate([owners, owners[twice]])
        pick = (mix64(nodes + np.uint64(1)) % np.uint64(ORDERS)).astype(np.int64)
        # The second child takes another order than the first.
        extra = mix64(nodes[len(nodes) - len(twice) :] + np.uint64(2)) % np.uint64(ORDERS - 1)
        if len(twice):
            pick[-len(twice) :] = (pick[-len(twice) :] + 1 + extra.astype(np.int64)) % ORDERS
        value = values[owners, pick].astype(np.uint64) | (pick.astype(np.uint64) << np.uint64(16))
        nodes = mix64(nodes * _STEP + value)
    return nodes, owners


def trees_after(rounds: int) -> int:
    """The trees that have been drawn after so many rounds of branching on."""
    return TREES + sum(EXTRA[:rounds])


def _entries(rows: DataFrame, levels: int, trees: range = range(TREES)) -> DataFrame:
    """(_node, _key) below the nodes of (_key, _sketch, _node), or below the roots of ``trees``."""
    roots = mix64(np.arange(trees.start + 1, trees.stop + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                n = part.num_rows
                keys = part.column(0).to_numpy()
                values = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(n, ORDERS)
                if part.num_columns == 2:
                    nodes, owners = np.tile(roots, n), np.repeat(np.arange(n), len(roots))
                else:
                    nodes, owners = part.column(2).to_numpy().astype(np.int64).view(np.uint64), np.arange(n)
                nodes, owners = grow(nodes, owners, values, levels)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes.view(np.int64)), pa.array(keys[owners])], names=["_node", "_key"]
                )

    return rows.mapInArrow(trimmed(run), "_node long, _key long")


def compare_pairs(
    pairs: DataFrame, payload: DataFrame, prepare: Callable[[list], list], score: Callable[[list, np.ndarray, np.ndarray], np.ndarray]
) -> DataFrame:
    """(a, b, parts, value) of pairs (a, b, g, parts), from the payload (_key, _data) of both sides.

    Pairs of a group g are dealt by their first document into as many cells as each row says,
    so a document's payload travels once for a cell, not for each pair, and a large group
    spreads over many cells. The rows carry that number; groups are not joined to their
    sizes. ``prepare`` turns a list of payloads into items, ``score`` rates pairs of item
    numbers.
    """
    pairs = stored(pairs.select("a", "b", "g", "parts"), "pairs")
    n = pairs.count()
    dealt = pairs.select(
        F.xxhash64("g", "parts", F.pmod(F.xxhash64("a"), F.col("parts"))).alias("_cell"), "a", "b", "parts"
    )
    wanted = dealt.select("_cell", F.col("a").alias("_key")).distinct().union(
        dealt.select("_cell", F.col("b").alias("_key")).distinct()
    )
    sides = payload.join(light(packed(wanted, 2 * n), 2 * n), "_key").select(
        "_cell", F.col("_key").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(None).cast("long").alias("parts"), "_data"
    )
    rows = sides.union(dealt.select("_cell", "a", "b", "parts", F.lit(None).cast("binary").alias("_data")))

    def settle(table: pa.Table) -> pa.RecordBatch:
        cell, a, b, parts = (table.column(i).fill_null(0).to_numpy() for i in (0, 1, 2, 3))
        is_pair = table.column(4).combine_chunks().is_null().to_numpy(zero_copy_only=False)
        docs = np.flatnonzero(~is_pair)
        items = prepare([table.column(4)[i].as_py() for i in docs])
        place = {pair: i for i, pair in enumerate(zip(cell[docs].tolist(), a[docs].tolist()))}
        both = np.flatnonzero(is_pair)
        left_at = np.array([place[p] for p in zip(cell[both].tolist(), a[both].tolist())], dtype=np.int64)
        right_at = np.array([place[p] for p in zip(cell[both].tolist(), b[both].tolist())], dtype=np.int64)
        value = score(items, left_at, right_at)
        return pa.RecordBatch.from_arrays(
            [pa.array(a[both]), pa.array(b[both]), pa.array(parts[both]), pa.array(value, pa.float64())],
            names=["a", "b", "parts", "value"],
        )

    return _by_cells(rows, settle, "a long, b long, parts long, value double", 3 * n)


def _parts(size: Column) -> Column:
    """Into how many cells a node of so many documents is dealt: a power of two, CELL documents in each."""
    return F.pow(F.lit(2), F.ceil(F.log2(F.greatest(size / CELL, F.lit(1.0))))).cast("long")


def _by_cells(
    rows: DataFrame, settle: Callable[[pa.Table], pa.RecordBatch], schema: str, n: int
) -> DataFrame:
    """Give whole cells of about ``n`` rows (_cell, ...) to ``settle``, many small ones at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows_held = bytes_held = 0
        for batch in batches:
            held.append(batch)
            rows_held, bytes_held = rows_held + batch.num_rows, bytes_held + batch.nbytes
            if bytes_held < 8 << 20 and rows_held < 50_000:
                continue
            table = pa.Table.from_batches(held)
            cell = table.column(0).to_numpy()
            whole = int(np.argmax(cell == cell[-1]))  # rows before the last cell
            if whole:
                yield settle(table.slice(0, whole))
            held = table.slice(whole).to_batches()
            rows_held, bytes_held = len(table) - whole, sum(x.nbytes for x in held)
        if rows_held:
            yield settle(pa.Table.from_batches(held))

    return packed(rows.repartition("_cell"), n, CELL_ROWS).sortWithinPartitions("_cell").mapInArrow(trimmed(run), schema)


def _estimate(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs whose sketches agree in at least ESTIMATE of the orders."""
    payload = reps.select("_key", F.col("_sketch").alias("_data"))

    def prepare(data: list) -> list:
        return np.frombuffer(b"".join(data), np.uint16).reshape(-1, ORDERS)

    def score(items: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = np.zeros(len(left))
        for lo in range(0, len(left), 4096):
            hi = lo + 4096
            out[lo:hi] = (items[left[lo:hi]] == items[right[lo:hi]]).mean(axis=1)
        return out

    return compare_pairs(pairs, payload, prepare, score).filter(F.col("value") >= ESTIMATE)


def _confirm(pairs: DataFrame, texts: DataFrame, words: int, similarity: int) -> DataFrame:
    """Pairs of which 100 * shared shingles reach ``similarity`` * all shingles."""
    payload = texts.select("_key", F.col("_text").cast("binary").alias("_data"))

    def prepare(data: list) -> list:
        sizes = np.array([len(d) for d in data], dtype=np.int64)
        return shingle_sets(np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum(sizes)], words)

    def score(items: list, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = np.zeros(len(left))
        for i, (x, y) in enumerate(zip(left.tolist(), right.tolist())):
            out[i] = _linked(items[x], items[y], similarity)
        return out

    return compare_pairs(pairs, payload, prepare, score).filter(F.col("value") > 0).select("a", "b")


def _cells_of(mixed: DataFrame, reps: DataFrame, n: int) -> DataFrame:
    """(_cell, _node, _key, _part, _own, _x, _met, _sketch): the documents of each cell of the nodes.

    ``mixed`` has at most ``n`` rows (_node, _key, _size, _part). A node's documents meet in one
    cell; those of a node that branching could not make small meet in cells of two blocks
    each, _own and _x. _met holds the document's nodes in order; trees and levels are few, so
    it is short.
    """
    blocks = F.ceil(F.col("_size") / CELL)
    met = mixed.groupBy("_key").agg(F.array_sort(F.collect_set("_node")).alias("_met"))
    docs = reps.select("_key", "_sketch").join(packed(met, n), "_key")
    dealt = mixed.select(
        "_node",
        "_key",
        "_part",
        F.pmod(F.xxhash64("_key"), blocks).alias("_own"),
        F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_x"),
    )
    cell = F.xxhash64("_node", F.least("_own", "_x"), F.greatest("_own", "_x"))
    return docs.join(light(dealt, n), "_key").select(
        cell.alias("_cell"), "_node", "_key", "_part", "_own", "_x", "_met", "_sketch"
    )


def _look_alikes(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers (left, right) and estimate of look-alikes of whole cells, from columns as _cells_of has them.

    Only pairs of different components, and each pair in one cell alone: that of the first node
    that both documents have, and there in the cell of their two blocks.
    """
    cell, node, _, part, own, x = (table.column(i).to_numpy() for i in range(6))
    met = table.column(6).combine_chunks()
    nodes, at_node = met.flatten().to_numpy(), met.offsets.to_numpy() - met.offsets[0].as_py()
    items = np.frombuffer(b"".join(table.column(7).to_pylist()), np.uint16).reshape(-1, ORDERS)
    ends = np.searchsorted(cell, cell, side="right")
    at = 0
    while at < len(cell):
        to = int(np.searchsorted(np.cumsum(ends[at:] - np.arange(at, len(cell))), 1 << 18)) + at + 1
        mates = ends[at:to] - np.arange(at, min(to, len(cell))) - 1
        left = np.repeat(np.arange(at, at + len(mates)), mates)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(mates) - mates, mates)
        apart = (part[left] != part[right]) & ((own[left] != own[right]) | (own[left] == x[left]))
        left, right = left[apart], right[apart]
        for lo in range(0, len(left), 8192):
            i, j = left[lo : lo + 8192], right[lo : lo + 8192]
            alike = (items[i] == items[j]).mean(axis=1)
            near = alike >= ESTIMATE
            i, j, alike = i[near], j[near], alike[near]
            first = np.array(
                [
                    np.intersect1d(
                        nodes[at_node[p] : at_node[p + 1]], nodes[at_node[q] : at_node[q + 1]], assume_unique=True
                    )[0] == node[p]
                    for p, q in zip(i.tolist(), j.tolist())
                ],
                dtype=bool,
            )
            yield i[first], j[first], alike[first]
        at += len(mates)


def _within_nodes(
    mixed: DataFrame, reps: DataFrame, texts: DataFrame, words: int, similarity: int, n: int
) -> DataFrame:
    """Confirmed links (a, b) that connect the components of documents which share a node.

    Pairs never leave the task that compares a cell. First the sketches travel, and the
    documents with a look-alike of another component stay; then the texts of these, and each
    cell confirms its look-alikes, the closest first, but for those that confirmed links of the
    cell already connect. So a cell gives fewer links than it has documents.
    """
    cells = _cells_of(mixed, reps, n)
    schema = "_cell long, _node long, _key long, _part long, _own long, _x long, _met array<long>, _sketch binary"

    def sift(table: pa.Table) -> pa.RecordBatch:
        stays = np.zeros(len(table), dtype=bool)
        for left, right, _ in _look_alikes(table):
            stays[left] = stays[right] = True
        kept = table.filter(pa.array(stays)).combine_chunks()
        return pa.RecordBatch.from_arrays(
            [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in kept.columns], names=kept.column_names
        )

    left = stored(_by_cells(cells, sift, schema, n), "look-alikes")
    n_left = left.count()
    rows = left.join(texts.select("_key", F.col("_text").cast("binary").alias("_data")), "_key").select(*left.columns, "_data")

    def settle(table: pa.Table) -> pa.RecordBatch:
        keys, parts = table.column(2).to_numpy(), table.column(3).to_numpy()
        cell, data = table.column(0).to_numpy(), table.column(8).to_pylist()
        sizes = np.array([len(d) for d in data], dtype=np.int64)
        sets = shingle_sets(np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum(sizes)], words)
        found = [np.concatenate(x) for x in zip(*_look_alikes(table))]
        joined: dict[tuple[int, int], tuple[int, int]] = {}  # a component within a cell -> one it is connected to

        def top(name: tuple[int, int]) -> tuple[int, int]:
            while (above := joined.get(name, name)) != name:
                joined[name] = joined.get(above, above)
                name = above
            return name

        a, b = [], []
        for at in np.argsort(-found[2], kind="stable").tolist() if found else []:
            i, j = int(found[0][at]), int(found[1][at])
            one, other = top((int(cell[i]), int(parts[i]))), top((int(cell[j]), int(parts[j])))
            if one != other and _linked(sets[i], sets[j], similarity):
                joined[one] = other
                a.append(int(max(keys[i], keys[j])))
                b.append(int(min(keys[i], keys[j])))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return _by_cells(rows, settle, "a long, b long", n_left)


def _to_components(
    minors: DataFrame, named: DataFrame, texts: DataFrame, words: int, similarity: int
) -> DataFrame:
    """Links (a, b) of documents ``minors`` (a, g) to members of the component g, if any.

    Every document is compared with every member, in cells of at most about CELL documents
    of either side; a cell gives one confirmed link of a document at most, as more would
    connect nothing new. ``named`` has (_key, _part) of all members.
    """
    minors, n = counted(minors)
    wanted = packed(minors.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("_na")), n)
    members = named.withColumnRenamed("_part", "g").join(light(wanted, n), "g")
    sizes = packed(members.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("_nb")), n)
    numbered = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("_x")
    left = minors.join(light(wanted, n), "g").join(light(sizes, n), "g").select(
        "g", F.pmod(F.xxhash64("a"), F.col("_na")).alias("_i"), numbered("_nb"), F.col("a").alias("_key")
    ).select(F.xxhash64("g", "_i", "_x").alias("_cell"), F.lit(True).alias("_minor"), "_key")
    right = members.join(light(sizes, n), "g").select(
        "g", F.pmod(F.xxhash64("_key", F.lit(1)), F.col("_nb")).alias("_j"), numbered("_na"), "_key"
    ).select(F.xxhash64("g", "_x", "_j").alias("_cell"), F.lit(False).alias("_minor"), "_key")
    dealt, n_dealt = counted(left.union(right))
    rows = texts.join(light(dealt, n_dealt), "_key").select(
        "_cell", "_minor", "_key", F.col("_text").cast("binary").alias("_data")
    )
    factors, shifts = _multipliers()

    def settle(table: pa.Table) -> pa.RecordBatch:
        cell, key = table.column(0).to_numpy(), table.column(2).to_numpy()
        minor = table.column(1).combine_chunks().to_numpy(zero_copy_only=False)
        data = table.column(3).to_pylist()
        sizes = np.array([len(d) for d in data], dtype=np.int64)
        sets = shingle_sets(np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum(sizes)], words)
        drawn = np.stack([sketch(s, factors, shifts) for s in sets])
        found = []
        for name in np.unique(cell):
            here = np.flatnonzero(cell == name)
            ours, theirs = here[minor[here]], here[~minor[here]]
            for i in ours.tolist():
                close = (drawn[theirs] == drawn[i]).mean(axis=1)
                for j in theirs[np.argsort(-close, kind="stable")][: int((close >= ESTIMATE).sum())].tolist():
                    if _linked(sets[i], sets[j], similarity):
                        found.append((int(key[i]), int(key[j])))
                        break
        a, b = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return _by_cells(rows, settle, "a long, b long", n_dealt)


def _linked(x: np.ndarray, y: np.ndarray, similarity: int) -> bool:
    """Whether two sorted sets share enough: 100 * shared >= similarity * all."""
    if 100 * min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= similarity * (len(both) - shared)


def similar_components(texts: DataFrame, words: int, similarity: int) -> DataFrame:
    """(_key, _name, _n, _root) of (_key, _name, _text): set size and the component.

    Rows of equal keys must have equal texts. Rows of equal sets are represented by their
    smallest key; ``_root`` is null for a set that is empty.
    """
    drawn = stored(sketches(texts, words), "sketches")
    # Equal sets have equal sketches, so any one will do.
    reps = stored(
        drawn.filter(F.col("_n") > 0).groupBy("_set").agg(F.min("_key").alias("_key"), F.first("_sketch").alias("_sketch")),
        "representatives",
    )
    roots, live = None, None
    frontier, n_frontier = _entries(reps.select("_key", "_sketch"), DEPTH), 1 << 62
    for turn in range(ROUNDS + 1):
        nodes = packed(
            frontier.groupBy("_node").agg(F.count(F.lit(1)).alias("_size"), F.min("_key").alias("_low")), n_frontier
        ).filter(F.col("_size") > 1)
        shared = stored(frontier.join(light(nodes, n_frontier), "_node"), "shared-nodes")
        n_shared = shared.count()
        if not n_shared:
            break
        if live is None:
            live = _texts_of(texts.select("_key", "_text"), shared.select("_key").distinct())
        # First each document meets the smallest of its nodes: most groups of copies join here.
        ends = shared.filter(F.col("_key") != F.col("_low")).groupBy(F.col("_key").alias("a"), F.col("_low").alias("b")).agg(
            F.max(_parts(F.col("_size"))).alias("parts")
        )
        best = _estimate(packed(ends, n_shared).withColumn("g", F.col("b")), reps).groupBy("a").agg(
            F.max_by(F.struct("b", "parts"), F.struct("value", F.bitwise_not("b"))).alias("best")
        )
        best = packed(best, n_shared).select("a", "best.*", F.col("best.b").alias("g"))
        roots = merge_roots(roots, _confirm(best, live, words, similarity))
        # Then nodes that still hold several components: small ones are compared exhaustively.
        before = roots
        inside = with_root(shared.select("_node", "_key", "_size"), before, "_key", "_part")
        parts = packed(inside.groupBy("_node", "_part").agg(F.count(F.lit(1)).alias("_n")), n_shared)
        split, n_split = counted(
            parts.groupBy("_node").agg(
                F.count(F.lit(1)).alias("_parts"), F.max(F.struct("_n", F.bitwise_not("_part").alias("_not"))).alias("_top")
            ).filter(F.col("_parts") > 1).select(
                "_node", F.col("_top._n").alias("_most"), F.bitwise_not("_top._not").alias("_main")
            )
        )
        if not n_split:
            break
        mixed = stored(inside.join(light(split, n_split), "_node"), "mixed-nodes")
        last = turn == ROUNDS
        small = mixed if last else mixed.filter(F.col("_size") <= SMALL_NODE)
        # In the last round a document meets several blocks of its node.
        links = _within_nodes(small, reps, live, words, similarity, 1 << 62 if last else mixed.count())
        roots = merge_roots(roots, links)
        large = mixed.filter(F.col("_size") > SMALL_NODE)
        if last or large.isEmpty():
            break
        # In a large node where one component is most of it, the others are compared with all
        # of that component, and branching goes on without it.
        dense = F.col("_most") * 2 >= F.col("_size")
        outside = large.filter(dense & (F.col("_part") != F.col("_main")))
        if not outside.isEmpty():
            minors = packed(outside.select(F.col("_key").alias("a"), F.col("_main").alias("g")).distinct(), n_shared)
            named = with_root(reps.select("_key"), before, "_key", "_part")
            roots = merge_roots(roots, _to_components(minors, named, live, words, similarity))
        onward = large.filter(~dense | (F.col("_part") != F.col("_main"))).select("_key", "_node")
        onward, n_onward = counted(onward)
        drawn_on = reps.select("_key", "_sketch").join(light(onward, n_onward), "_key")
        deeper = _entries(drawn_on.select("_key", "_sketch", "_node"), MORE)
        # A pair shares a deeper node of a tree with less chance, so these documents get more trees.
        again = reps.select("_key", "_sketch").join(
            light(packed(onward.select("_key").distinct(), n_onward), n_onward), "_key"
        )
        more = _entries(again, DEPTH + MORE * (turn + 1), range(trees_after(turn), trees_after(turn + 1)))
        frontier = stored(deeper.union(more), "deeper-nodes")
        n_frontier = frontier.count()
    named = with_root(reps.select("_set", "_key"), roots, "_key", "_root").select("_set", "_root")
    return drawn.select("_key", "_name", "_n", "_set").join(named, "_set", "left").drop("_set")


def _texts_of(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """The texts of representatives that share a node with another; few keys are broadcast."""
    keys, n = counted(keys)
    return stored(texts.join(light(keys, n), "_key", "left_semi"), "candidate-texts")


_NO_KEY = -(2**63)


def _row_key(docs: DataFrame, key: str, text: str) -> tuple[Column, bool]:
    """What names a row: the key, or a hash of key and text where keys repeat; and if they do."""
    name = F.coalesce(F.col(key).cast("long"), F.lit(_NO_KEY))
    repeats = not docs.groupBy(name.alias("_key")).count().filter(F.col("count") > 1).isEmpty()
    return (F.xxhash64(name, F.coalesce(F.col(text), F.lit(""))) if repeats else name), repeats


def _judged(docs: DataFrame, key: str, text: str, words: int, similarity: int) -> DataFrame:
    """(_key, _name, _n, _root as the smallest name of the component)."""
    row, repeats = _row_key(docs, key, text)
    name = F.coalesce(F.col(key).cast("long"), F.lit(_NO_KEY))
    given = docs.select(row.alias("_key"), name.alias("_name"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    found = similar_components(given, words, similarity)
    if repeats:
        least = found.filter(F.col("_root").isNotNull()).groupBy("_root").agg(F.min("_name").alias("_least"))
        found = found.join(least, "_root", "left").drop("_root").withColumnRenamed("_least", "_root")
    return found.withColumn("_root", F.coalesce("_root", "_name"))


def near_duplicates(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, similarity: int = 80
) -> DataFrame:
    """key, n_shingles, component_id and kept of every row.

    A document's set holds the distinct runs of ``words`` words (A-Z as a-z; fewer words: the
    whole sequence; none or a null text: empty, linked with nothing). Documents whose sets
    have 100 * shared >= ``similarity`` * all are linked; component_id is the smallest key
    reachable. Exactly one row of a component is kept, that of component_id; where rows
    repeat that key, each of them is. A null key takes part as the smallest and comes back
    as null. An empty table gives no rows; other columns are ignored.
    """
    found = _judged(docs, key, text, words, similarity)
    back = lambda c: F.when(F.col(c) != _NO_KEY, F.col(c)).cast(docs.schema[key].dataType)
    return found.select(
        back("_name").alias(key),
        F.col("_n").alias("n_shingles"),
        back("_root").alias("component_id"),
        (F.col("_name") == F.col("_root")).alias("kept"),
    )


def keep_representatives(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, similarity: int = 80
) -> DataFrame:
    """One row of each component of ``near_duplicates``, unchanged: one of the smallest key.

    Where rows repeat that key, the one of the smallest row name stays. Rows without words
    are in no component; of equal texts under one key one stays.
    """
    row, repeats = _row_key(docs, key, text)
    name = F.coalesce(F.col(key).cast("long"), F.lit(_NO_KEY))
    given = docs.select(row.alias("_key"), name.alias("_name"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    found = similar_components(given, words, similarity).filter(F.col("_root").isNotNull())
    if repeats:
        first = found.groupBy("_root").agg(F.min(F.struct("_name", "_key")).alias("_first"))
        lost = found.join(first, "_root").filter(F.struct("_name", "_key") != F.col("_first"))
    else:
        lost = found.filter(F.col("_name") != F.col("_root"))
    gone, n = counted(lost.select(F.col("_key").alias("_gone")).distinct())
    named = docs.select(row.alias("_gone"), F.struct("*").alias("_given"))
    left = named.join(light(gone, n), "_gone", "left_anti").select("_given.*")
    return left.dropDuplicates([key, text]) if repeats else left
