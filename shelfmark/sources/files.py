"""File relations: from a listing, from a mounted tree, or from a table of contents."""

import uuid
from collections.abc import Iterator, Sequence
from itertools import chain, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths, text
from ..operators.selection import exclude_dot_paths
from ..session import wide, work_dir

LISTED = (
    "path string, is_dir boolean, size_bytes bigint, created_at timestamp, "
    "modified_at timestamp, accessed_at timestamp, read_error string"
)
MAX_LENGTH = "spark.sql.sources.binaryFile.maxLength"


def _with_names(df: DataFrame, root: str) -> DataFrame:
    path = F.col("path")
    return df.withColumns(
        {
            "filename": paths.filename(path),
            "directory": paths.directory(path),
            "extension": paths.extension(path),
            "depth": paths.depth(path, root).cast("int"),
        }
    )


def files_from_table(
    df: DataFrame, path: str = "path", content: str = "content", root: str = "/"
) -> DataFrame:
    """The file relation over a table that already holds paths and contents."""
    rest = [c for c in df.columns if c not in (path, content)]
    renamed = df.select(F.col(path).alias("path"), F.col(content).alias("content"), *rest)
    if "size_bytes" not in rest:
        renamed = renamed.withColumn("size_bytes", F.octet_length("content").cast("long"))
    return _with_names(renamed, root)


def _any_case(suffixes: Sequence[str]) -> str:
    """A name filter for suffixes in any case, as the file listing understands it."""
    spelled = [
        "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
        for suffix in suffixes
    ]
    return "*{" + ",".join(spelled) + "}"


def qualified_root(spark: SparkSession, root: str) -> str:
    """The root as it starts the paths of a scan: plain for local files, else with scheme
    and host, which the cluster's default file system may add."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    file_system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    full = file_system.makeQualified(path).toString()
    return "/" + full.removeprefix("file:").lstrip("/") if full.startswith("file:") else full


def max_length(spark: SparkSession) -> int:
    """The largest file whose content is read, as Spark's binary files are set up."""
    return int(spark.conf.get(MAX_LENGTH, str(2**31 - 1)))


def scan_files(
    spark: SparkSession,
    root: str,
    with_content: bool = False,
    hidden: bool | None = None,
    suffixes: Sequence[str] = (),
) -> DataFrame:
    """Every file below ``root``: path, names, size, times, depth and optionally the bytes.

    A mounted tree (a local path, the same on all executors) is listed by the executors,
    with all three times; names that start with a dot come only with ``hidden``. Other
    stores, and any with ``hidden=False``, are listed by Spark itself, which leaves out
    names that start with a dot or an underscore and knows only the modification time.
    Contents are read only if asked for. ``suffixes`` restricts the listing, so that no
    other file is read. A directory or file of a mounted tree that cannot be read leaves a
    row with ``read_error``.
    """
    base = qualified_root(spark, root)
    if hidden or (hidden is None and base.startswith("/")):
        files = list_tree(spark, base)
        if not hidden:
            files = exclude_dot_paths(files, base)
        if suffixes:
            files = files.where(paths.extension(F.col("path")).isin(*suffixes))
        if with_content:
            files = with_bytes(files, F.lit(True))
        return _with_names(files, base)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if suffixes:
        reader = reader.option("pathGlobFilter", _any_case(suffixes))
    listed = reader.load(root)
    # Local paths lose their scheme; others keep scheme and host.
    path = F.regexp_replace("path", "^file:/+", "/")
    columns = [
        path.alias("path"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
    ]
    if with_content:
        columns.append(F.col("content"))
    return _with_names(listed.select(*columns), base)


PIECE_ENTRIES = 10_000  # entries of a directory that a task holds at once
PIECE_BYTES = 32 << 20  # bytes of file contents that a task holds at once, or one file
TEXT_BYTES = 2 << 20  # bytes of a text that are profiled at once; longer files come in pieces


def _scan_directories(batches: Iterator) -> Iterator:
    """List directories in bounded pieces; what cannot be read is a row with ``read_error``."""
    import os
    from datetime import datetime, timezone

    columns = LISTED.replace(" bigint", "").replace(" boolean", "").replace(" string", "")
    columns = columns.replace(" timestamp", "").split(", ")

    def at(seconds: float) -> datetime:
        return datetime.fromtimestamp(seconds, timezone.utc)

    def row(entry: os.DirEntry) -> tuple | None:
        try:
            # A link to a file is a file; a link to a directory is not entered.
            is_dir = entry.is_dir(follow_symlinks=False)
            if not is_dir and not entry.is_file():
                return None
            s = entry.stat()
        except OSError as problem:
            return entry.path, False, None, None, None, None, type(problem).__name__
        return entry.path, is_dir, s.st_size, at(s.st_ctime), at(s.st_mtime), at(s.st_atime), None

    def rows(directory: str) -> Iterator[tuple]:
        try:
            with os.scandir(directory) as entries:
                yield from filter(None, map(row, entries))
        except OSError as problem:  # unreadable or gone: the rest of the tree is still listed
            yield directory, True, None, None, None, None, type(problem).__name__

    for batch in batches:
        found = chain.from_iterable(map(rows, batch["path"]))
        while piece := list(islice(found, PIECE_ENTRIES)):
            yield pd.DataFrame(piece, columns=columns)


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """List a mounted tree level by level; every level is spread over the executors.

    Each level is written to the shared work folder, which cuts the lineage and lets a
    lost executor be replaced. A level holds the directories of one depth, so one very
    large subtree is split like any other.
    """
    folder = f"{work_dir(spark)}/listing-{uuid.uuid4().hex}"
    level, frontier = 0, spark.createDataFrame([(root,)], "path string")
    while True:
        spread = frontier.repartition(wide(spark), F.col("path")) if level else frontier
        target = f"{folder}/level={level}"
        spread.mapInPandas(_scan_directories, LISTED).write.parquet(target)
        listed = spark.read.parquet(target)
        if level == 0 and not listed.where((F.col("path") == root) & F.col("read_error").isNotNull()).isEmpty():
            raise FileNotFoundError(root)
        frontier = listed.where("is_dir AND read_error IS NULL").select("path")
        if frontier.isEmpty():
            break
        level += 1
    files = spark.read.schema(LISTED).parquet(*[f"{folder}/level={i}" for i in range(level + 1)])
    return files.where(~F.col("is_dir") | F.col("read_error").isNotNull()).drop("is_dir")


def _dealt(asked: DataFrame) -> DataFrame:
    """The files of a listing in turn over many tasks, at least one for so many bytes to read."""
    total = asked.agg(F.sum(F.when(F.col("__take"), F.col("size_bytes")))).first()[0]
    return asked.repartition(max(wide(asked.sparkSession), -(-total // PIECE_BYTES))) if total else asked


def with_bytes(files: DataFrame, wanted: Column) -> DataFrame:
    """Add the bytes of the wanted files of a mounted tree as ``content``; a file that cannot
    be read gets a ``read_error``.

    A task holds the contents of about ``PIECE_BYTES`` at once, or of one larger file,
    however many files a partition has. A listing is small and would stay in few tasks, so
    its files are dealt out first.
    """
    names = files.columns
    at_path, at_error, bound = names.index("path"), names.index("read_error"), PIECE_BYTES
    asked = files.withColumn("__take", F.coalesce(wanted, F.lit(False)) & F.col("read_error").isNull())
    asked = _dealt(asked)
    schema = T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType())])

    def read(name: str) -> tuple[bytes | None, str | None]:
        try:
            with open(name, "rb") as f:
                return f.read(), None
        except OSError:
            return None, "could not be read"

    def piece(rows: pa.RecordBatch, contents: list[bytes | None], errors: list[str | None]) -> pa.RecordBatch:
        columns = [*rows.columns[:-1], pa.array(contents, pa.binary())]
        columns[at_error] = pa.array(errors, pa.string())
        return pa.RecordBatch.from_arrays(columns, names=[*names, "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, size, contents, errors = 0, 0, [], []
            for i, (name, take) in enumerate(zip(batch.column(at_path).to_pylist(), batch.column(len(names)).to_pylist())):
                content, problem = read(name) if take else (None, batch.column(at_error)[i].as_py())
                contents.append(content)
                errors.append(problem)
                size += len(content or b"")
                if size >= bound:
                    yield piece(batch.slice(lo, i + 1 - lo), contents, errors)
                    lo, size, contents, errors = i + 1, 0, [], []
            if contents:
                yield piece(batch.slice(lo), contents, errors)

    return asked.mapInArrow(run, schema)


def is_long(size_bytes: Column) -> Column:
    """Whether a text of this size is profiled in pieces."""
    return F.coalesce(size_bytes > TEXT_BYTES, F.lit(False))


def text_pieces(files: DataFrame) -> DataFrame:
    """``path, piece, content, read_error``: the bytes of files of a mounted tree in numbered pieces
    of about ``TEXT_BYTES``, read by many tasks.

    A piece ends behind ASCII white space or another control character, but not behind a carriage
    return. So no character, line end or word is cut, and each piece can be decoded, lower-cased
    and cut into words on its own. A run without such a byte stays in one piece; the pieces that
    begin within it are empty. The last piece goes to the end that the file has when it is read.
    """
    step, block = TEXT_BYTES, 1 << 16
    last = F.floor(F.greatest(F.col("size_bytes") - 1, F.lit(0)) / step)
    places = files.select("path", last.alias("last"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    total = files.agg(F.sum("size_bytes")).first()[0] or 0
    dealt = places.repartition(max(wide(files.sparkSession), -(-total // PIECE_BYTES)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        blank = re.compile(rb"[\x00-\x0c\x0e-\x20]")

        def up_to_blank(f, most: int | None = None) -> tuple[list[bytes], bool]:
            """The bytes up to the first blank and with it, at most so many; whether there was one."""
            parts = []
            while (most is None or most > 0) and (part := f.read(block if most is None else min(block, most))):
                if found := blank.search(part):
                    parts.append(part[: found.end()])
                    return parts, True
                parts.append(part)
                most = None if most is None else most - len(part)
            return parts, False

        def read(name: str, piece: int, last: int) -> bytes:
            start, end = piece * step, None if piece == last else (piece + 1) * step - 1
            with open(name, "rb") as f:
                if piece:
                    f.seek(start - 1)
                    skipped, found = up_to_blank(f, None if end is None else end - start + 1)
                    if not found:
                        return b""
                    start += sum(map(len, skipped)) - 1
                    f.seek(start)
                if end is None:
                    return f.read()
                return b"".join([f.read(end - start), *up_to_blank(f)[0]])

        for batch in batches:
            for row in batch.to_pylist():
                try:
                    content, problem = read(row["path"], row["piece"], row["last"]), None
                except OSError:
                    content, problem = None, "could not be read"
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["path"]]), pa.array([row["piece"]], pa.int64()),
                     pa.array([content], pa.binary()), pa.array([problem], pa.string())],
                    names=["path", "piece", "content", "read_error"],
                )

    return dealt.mapInArrow(run, "path string, piece bigint, content binary, read_error string")


def read_text_content(
    files: DataFrame, max_chars: int | None = None, content: str = "content"
) -> DataFrame:
    """Decode the contents: UTF-8 with replacement, ``\\n`` line ends, optional prefix."""
    return files.withColumn(content, text.decode_text(F.col(content), max_chars))
