"""Turn a small text → record helper into an Arrow-batched column function."""

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def map_texts(content: Column, helper: Callable[[str], dict], ddl: str) -> Column:
    """Apply ``helper`` to every non-null text; the result is a struct column.

    Only the text column travels to Python, in Arrow batches; the rest of the row stays
    in the JVM and no shuffle takes place.
    """
    return_type = T.DataType.fromDDL(ddl)
    arrow_type = to_arrow_type(return_type)

    @F.arrow_udf(return_type)
    def run(texts: pa.Array) -> pa.Array:
        rows = [None if t is None else helper(t) for t in texts.to_pylist()]
        return pa.array(rows, type=arrow_type)

    return run(content)
