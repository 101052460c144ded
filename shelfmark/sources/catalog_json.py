"""Save a catalog as JSON records and read it back; the flat typed form of a record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"

# The fields of the typed index form and their types.
INDEX_FIELDS = {
    "path": "string",
    "filename": "string",
    "extension": "string",
    "size_bytes": "bigint",
    "created_at": "timestamp",
    "modified_at": "timestamp",
    "accessed_at": "timestamp",
    "mime_type": "string",
    "encoding": "string",
    "content_preview": "string",
    "line_count": "int",
    "word_count": "int",
    "char_count": "int",
    "language": "string",
    "keywords": "array<string>",
}


def write_catalog_json(df: DataFrame, directory: str, mode: str = "overwrite") -> None:
    """One JSON record per file, keyed by its full path, times as ISO text."""
    df.write.mode(mode).option("timestampFormat", ISO_FORMAT).json(directory)


def read_catalog_json(
    spark: SparkSession, directory: str, schema: T.StructType | str
) -> DataFrame:
    """Load saved records; the schema is declared, so nothing is read to infer it."""
    return spark.read.schema(schema).option("timestampFormat", ISO_FORMAT).json(directory)


def to_index_schema(catalog: DataFrame) -> DataFrame:
    """The flat typed form: 15 named fields, missing ones null."""
    has_file = "file" in catalog.columns
    inner = catalog.schema["file"].dataType.fieldNames() if has_file else []

    def source(name: str):
        if name in catalog.columns:
            return F.col(name)
        if name in inner:
            return F.col(f"file.{name}")
        return F.lit(None)

    return catalog.select(*[source(n).cast(t).alias(n) for n, t in INDEX_FIELDS.items()])
