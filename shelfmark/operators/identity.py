"""Identity, times and MIME type of a file row."""

from __future__ import annotations

import mimetypes
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import DEFAULT_MIME_TYPE
from ..functions import paths


def file_struct(path: Column, size_bytes: Column) -> Column:
    return F.struct(
        paths.filename(path).alias("filename"),
        paths.directory(path).alias("directory"),
        paths.extension(path).alias("extension"),
        size_bytes.cast("long").alias("size_bytes"),
    )


def file_identity(df: DataFrame) -> DataFrame:
    """Add ``file``: name, parent directory, lower-case last suffix and size."""
    return df.withColumn("file", file_struct(F.col("path"), F.col("size_bytes")))


def suffix_types(extra: Mapping[str, str] | None = None) -> dict[str, str]:
    """Suffix → MIME type: the standard library's own table, independent of the machine."""
    table = dict(mimetypes.MimeTypes(filenames=()).types_map[True])
    table.update({k.lower(): v for k, v in (extra or {}).items()})
    return table


def _compression() -> tuple[dict[str, str], dict[str, str]]:
    """Suffix → encoding, and short suffix → its two-part form (``.tgz`` → ``.tar.gz``)."""
    known = mimetypes.MimeTypes(filenames=())
    return dict(known.encodings_map), dict(known.suffix_map)


def _last_suffix(name: Column) -> Column:
    """Last dot and what follows; leading dots belong to the name."""
    return F.regexp_extract(name, r"^\.*[^.].*?(\.[^.]*)$", 1)


def guess_mime(df: DataFrame, extra_types: Mapping[str, str] | None = None) -> DataFrame:
    """Add ``mime_type`` and ``encoding`` from the suffix of ``path``.

    The suffix table is fixed and small (a few hundred rows, from the standard library),
    so it is joined by broadcast; ``extra_types`` must be of that kind too.
    """
    encodings, aliases = _compression()
    types = suffix_types(extra_types)
    if len(types) > 100_000:
        raise ValueError("the suffix table is meant for a broadcast; pass a short mapping")
    dimension = df.sparkSession.createDataFrame(
        sorted(types.items()), "__suffix string, __mime string"
    )

    name = paths.filename(F.col("path"))
    outer = _last_suffix(name)
    alias_map = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    encoding_map = F.create_map(*[F.lit(x) for pair in encodings.items() for x in pair])
    expanded = F.try_element_at(alias_map, F.lower(outer))
    full = F.when(
        expanded.isNotNull(),
        F.concat(F.substr(name, F.lit(1), F.length(name) - F.length(outer)), expanded),
    ).otherwise(name)
    last = F.when(expanded.isNotNull(), _last_suffix(full)).otherwise(outer)
    encoding = F.try_element_at(encoding_map, last)
    inner = F.when(
        encoding.isNotNull(),
        _last_suffix(F.substr(full, F.lit(1), F.length(full) - F.length(last))),
    ).otherwise(last)

    return (
        df.withColumn("encoding", encoding)
        .withColumn("__suffix", F.lower(inner))
        .join(F.broadcast(dimension), "__suffix", "left")
        .withColumn("mime_type", F.coalesce("__mime", F.lit(DEFAULT_MIME_TYPE)))
        .drop("__suffix", "__mime")
    )


def basic_metadata(df: DataFrame, extra_types: Mapping[str, str] | None = None) -> DataFrame:
    """Path, identity, the three times, MIME type and encoding of every file.

    Times the listing does not have are null.
    """
    have = set(df.columns)
    for name in ("created_at", "modified_at", "accessed_at"):
        if name not in have:
            df = df.withColumn(name, F.lit(None).cast("timestamp"))
    return guess_mime(file_identity(df), extra_types)
