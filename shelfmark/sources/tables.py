"""Tabular files as DataFrames of text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tabular import is_record_array
from .quoted import quoted_records


class NonTabularError(ValueError):
    """The JSON text is not an array of objects."""


def _text_columns(names: list[str]) -> str:
    return ", ".join(f"`{n.replace('`', '``')}` string" for n in names)


def read_delimited(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A ``.csv`` file (comma) or any other delimited file (tab) with a header line.

    All columns are text. Files are split between tasks, also with ``multi_line``, which
    quoted line ends need: then records are found by ``quoted_records`` in two passes over
    the splits, and each is parsed by Spark on its own. Empty lines are no records.
    """
    separator = "," if path.lower().endswith(".csv") else "\t"
    options = {"sep": separator, "quote": '"', "escape": '"'}
    reader = spark.read.options(header=True, inferSchema=False, **options)
    if not multi_line:
        return reader.csv(path)
    # Only the first record is read for the names.
    schema = _text_columns(reader.option("multiLine", True).csv(path).columns)
    records = quoted_records(spark, path, separator).where(~F.col("is_first") & (F.col("text") != ""))
    return records.select(F.from_csv("text", schema, options).alias("r")).select("r.*")


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of objects as rows; the first object names the columns, as text.

    Raises ``NonTabularError`` for anything else. Only the names of the first object are
    looked at when the plan is built.
    """
    head = spark.read.text(path, wholetext=True).select(
        F.when(
            F.col("value").rlike(r"^\s*\[\s*\{"),
            F.array_distinct(F.json_object_keys(F.get_json_object("value", "$[0]"))),
        ).alias("keys")
    ).head()
    if head is None or head["keys"] is None:
        raise NonTabularError(path)
    return spark.read.schema(_text_columns(head["keys"])).option("multiLine", True).json(path)


def json_table_summary(df: DataFrame, content: str = "content") -> DataFrame:
    """Add ``format``, ``structure`` (``non-tabular`` or null), ``row_count``,
    ``column_count`` and ``columns`` of JSON texts."""
    text = F.col(content)
    tabular = F.coalesce(is_record_array(text), F.lit(False))
    first_keys = F.array_distinct(F.json_object_keys(F.get_json_object(text, "$[0]")))
    return df.withColumns(
        {
            "format": F.lit("json"),
            "structure": F.when(~tabular, F.lit("non-tabular")),
            "row_count": F.when(tabular, F.json_array_length(text)).cast("long"),
            "column_count": F.when(tabular, F.size(first_keys)).cast("long"),
            "columns": F.when(tabular, first_keys),
        }
    )
