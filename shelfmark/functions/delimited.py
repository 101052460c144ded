"""Cut delimited text that sits in one column into rows of cells."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def table_rows(content: Column, delimiter: Column) -> Column:
    """The rows of a delimited text as an array of arrays of cells; null for null.

    A quote opens a quoted cell only where a cell begins; elsewhere it is a character like
    any other. A quote inside a quoted cell is written twice. Blank lines are no rows. The
    standard library cuts one text at a time; only the two columns travel, in Arrow batches.
    """

    @F.arrow_udf("array<array<string>>")
    def cut(texts: pa.Array, separators: pa.Array) -> pa.Array:
        import csv
        import io

        csv.field_size_limit(2**31 - 1)
        rows = [
            None if text is None else [row for row in csv.reader(io.StringIO(text, newline=""), delimiter=sep) if row]
            for text, sep in zip(texts.to_pylist(), separators.to_pylist())
        ]
        return pa.array(rows, type=pa.list_(pa.list_(pa.string())))

    return cut(content, delimiter)
