"""Delimited files with line ends inside quoted cells, each read by many tasks.

Spark splits a file into blocks at line ends, where it is not known whether a quoted cell is
open. A first pass finds what each block does to that question: the state at its end for
either state at its start. These effects are composed along a file, which gives every block
its state, and a second pass cuts the blocks into records. Only records that lie in several
blocks, at most one per border, are put together by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCKS_BROADCAST = 500_000  # blocks of one scan whose states are broadcast at most


def open_after(line: str, is_open: bool, separator: str) -> bool:
    """Whether a quoted cell is open at the end of a line, given whether one was at its start.

    A quote opens a cell only where a cell begins; a quote inside is written twice; what
    follows the closing quote belongs to the cell up to the next separator.
    """
    at = 0
    while True:
        if is_open:
            at = line.find('"', at)
            while at >= 0 and line.startswith('"', at + 1):
                at = line.find('"', at + 2)
            if at < 0:
                return True
            at = line.find(separator, at + 1)
            if at < 0:
                return False
            at += len(separator)
        if line.startswith('"', at):
            at += 1
        else:
            at = line.find(separator + '"', at)
            if at < 0:
                return False
            at += len(separator) + 1
        is_open = True


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The rows of a batch block by block: ((file, block), rows)."""
    if not batch.num_rows:
        return
    files, blocks = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
    codes = files.indices.to_numpy()
    cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(codes) != 0)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        yield (batch.column(0)[lo].as_py(), int(blocks[lo])), batch.slice(lo, hi - lo)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, at, value``: the lines of the files, in order within a block."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )


def block_states(lines: DataFrame, separator: str) -> DataFrame:
    """``file, block, inside``: whether a quoted cell is open at the start of each block.

    Only lines with a quote travel to Python; a block becomes one row with its two ends. An
    effect is constant, the identity or a change of sides, so the state is the value of the
    last constant block, changed as often as sides were since: window functions over the few
    rows of a file.
    """

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list[bool]] = {}
        for batch in batches:
            for key, rows in _stretches(batch):
                ends = found.setdefault(key, [False, True])
                for line in rows.column(2).drop_null().to_pylist():
                    ends[:] = [open_after(line, e, separator) for e in ends]
        if found:
            names, blocks = zip(*found)
            outside, inside = zip(*found.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array(blocks, pa.int64()), pa.array(outside), pa.array(inside)],
                names=["file", "block", "from_outside", "from_inside"],
            )

    quoted = lines.select("file", "block", F.when(F.contains("value", F.lit('"')), F.col("value")).alias("value"))
    ends = quoted.mapInArrow(effects, "file string, block long, from_outside boolean, from_inside boolean")
    constant = F.col("from_outside") == F.col("from_inside")
    change = F.when(F.col("from_outside") & ~F.col("from_inside"), F.lit(1)).otherwise(F.lit(0))
    along = Window.partitionBy("file").orderBy("block")
    upto, before = along.rowsBetween(Window.unboundedPreceding, 0), along.rowsBetween(Window.unboundedPreceding, -1)
    marked = ends.withColumn("changes", F.sum(change).over(upto)).withColumn(
        "fixed", F.when(constant, F.struct(F.col("from_outside").cast("int").alias("value"), "changes"))
    )
    last = F.last("fixed", ignorenulls=True).over(before)
    done = F.coalesce(F.last("changes").over(before), F.lit(0))
    return marked.withColumns({"last": last, "done": done}).select(
        "file", "block",
        (
            (F.coalesce("last.value", F.lit(0)) + F.col("done") - F.coalesce("last.changes", F.lit(0))) % 2 == 1
        ).alias("inside"),
    )


_PIECES = "file string, block long, is_first boolean, kind string, text string"


class _Cutter:
    """Cuts the lines of one block after the other into records and pieces of records."""

    def __init__(self, separator: str):
        self.separator, self.key, self.held, self.kind = separator, None, [], "whole"

    def start(self, key: tuple[str, int], inside: bool) -> None:
        self.key, self.inside, self.held, self.kind = key, inside, [], "head" if inside else "whole"
        self.is_first = key[1] == 0

    def finish(self) -> pa.RecordBatch | None:
        """What is still held at the end of a block: the start of a record, or a part of one."""
        if not self.held:
            return None
        held, self.held = self.held, []
        return self._rows(pa.array(["\n".join(held)]), "open" if self.kind == "whole" else "middle")

    def _rows(self, texts: pa.Array, kind: str) -> pa.RecordBatch:
        n = len(texts)
        first = np.zeros(n, dtype=bool)
        first[0], self.is_first = self.is_first, False
        return pa.RecordBatch.from_arrays(
            [pa.array([self.key[0]] * n), pa.array(np.full(n, self.key[1])), pa.array(first), pa.array([kind] * n),
             texts.cast(pa.string())],
            names=["file", "block", "is_first", "kind", "text"],
        )

    def cut(self, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        """Lines without a quote are records as they are, or all belong to the open cell."""
        at = 0
        quoted = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)).tolist()
        for q in [*quoted, len(lines)]:
            if q > at:
                between = lines.slice(at, q - at)
                if self.inside:
                    self.held += between.to_pylist()
                else:
                    yield self._rows(between, "whole")
            if q == len(lines):
                return
            line = lines[q].as_py()
            self.inside = open_after(line, self.inside, self.separator)
            self.held.append(line)
            if not self.inside:
                yield self._rows(pa.array(["\n".join(self.held)]), self.kind)
                self.held, self.kind = [], "whole"
            at = q + 1


def _pieces(lines: DataFrame, states: DataFrame, separator: str) -> DataFrame:
    """Whole records, and pieces of those that lie in several blocks."""
    n = states.count()
    if n <= BLOCKS_BROADCAST:
        known = lines.join(F.broadcast(states), ["file", "block"])
    else:
        known = lines.join(states, ["file", "block"]).sortWithinPartitions("file", "block", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _Cutter(separator)
        for batch in batches:
            for key, rows in _stretches(batch):
                if key != cutter.key:
                    if (rest := cutter.finish()) is not None:
                        yield rest
                    cutter.start(key, rows.column(3)[0].as_py())
                yield from cutter.cut(rows.column(2))
        if (rest := cutter.finish()) is not None:
            yield rest

    return known.select("file", "block", "value", "inside").mapInArrow(run, _PIECES)


def quoted_records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """``file, is_first, text``: the records of delimited files, as text.

    Line ends inside a record are ``\\n``. A quoted cell that is still open where a file
    ends takes the rest of the file. Both passes read the files in Spark's splits.
    """
    lines = _lines(spark, path)
    lines = lines.withColumn("value", F.regexp_replace("value", "\r$", ""))
    pieces = _pieces(lines, block_states(lines, separator), separator)
    whole = pieces.where(F.col("kind") == "whole").select("file", "is_first", "text")
    # At most two pieces of each block: the end of one record and the start of another.
    parts = pieces.where(F.col("kind") != "whole").withColumn("later", F.col("kind") == "open")
    along = Window.partitionBy("file").orderBy("block", "later").rowsBetween(Window.unboundedPreceding, 0)
    numbered = parts.withColumn("record", F.sum(F.col("later").cast("int")).over(along))
    joined = numbered.groupBy("file", "record").agg(
        F.bool_or("is_first").alias("is_first"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("block", "later", "text"))), lambda p: p["text"]), "\n"
        ).alias("text"),
    )
    return whole.unionByName(joined.select("file", "is_first", "text"))
