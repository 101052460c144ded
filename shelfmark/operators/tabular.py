"""Shape, column types and column statistics of tables and of tabular files.

A table is profiled by one aggregation whose partial result is a single row per task;
only that row is shuffled. Files held in a column are cut into cells first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import delimited, paths, values
from ..functions import json_text as jt
from . import quantiles

STATISTICS = ["count", "null_count", "min", "max", "mean", "median"]


def table_shape(df: DataFrame) -> DataFrame:
    """One row: ``column_count``, ``row_count`` and ``columns``."""
    return df.agg(F.count("*").alias("row_count")).select(
        F.lit(len(df.columns)).cast("long").alias("column_count"),
        "row_count",
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
    )


def _prepare(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """One column set per input column: ``p`` present, ``v`` number, ``t`` text.

    The numbers of a text column are computed once here, below the aggregation that
    uses them several times. Returns the kind of every column as well.
    """
    kinds, out = {}, []
    for i, field in enumerate(df.schema.fields):
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.NumericType):
            kinds[field.name] = "number"
            out += [column.isNotNull().alias(f"p{i}"), column.cast("double").alias(f"v{i}")]
        elif isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
            kinds[field.name] = "text"
            present = F.when(column != "", column)
            out += [
                present.isNotNull().alias(f"p{i}"),
                values.parse_number(present).alias(f"v{i}"),
                present.alias(f"t{i}"),
            ]
        else:
            kinds[field.name] = (
                "date" if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))
                else "boolean" if isinstance(kind, T.BooleanType)
                else "other"
            )
            out.append(column.isNotNull().alias(f"p{i}"))
    return df.select(*out), kinds


def _column_profiles(
    prepared: DataFrame, kinds: dict[str, str], median: str | None
) -> DataFrame:
    """One pass over the table: a row of aggregates, turned into one row per column.

    ``median`` adds ``sketch`` columns, an ``approx`` or a (bounded input only) ``sample``
    value, or nothing.
    """
    aggregates, rows = [F.count("*").alias("n")], []
    zero, missing = F.lit(0).cast("long"), F.lit(None).cast("double")
    for i, (name, kind) in enumerate(kinds.items()):
        parts = {"n_present": F.count_if(F.col(f"p{i}"))}
        if kind in ("number", "text"):
            v = F.col(f"v{i}")
            parts |= {
                "n_number": F.count(v),
                "n_integral": F.count_if(values.is_integral(v)),
                "min": F.min(v), "max": F.max(v), "mean": F.avg(v),
            }
            if median == "sketch":
                parts["ends"] = quantiles.bracket(v)
            elif median == "approx":
                parts["median"] = F.percentile_approx(v, 0.5)
            elif median == "sample":
                parts["median"] = F.percentile(v, F.lit(0.5))
        if kind == "text":
            parts["n_date"] = F.count_if(values.is_date_text(F.col(f"t{i}")))
            parts["n_flag"] = F.count_if(values.is_boolean_text(F.col(f"t{i}")))
        aggregates += [a.alias(f"{part}_{i}") for part, a in parts.items()]

        def part(field: str, default: Column, i=i, parts=parts) -> Column:
            return F.col(f"{field}_{i}") if field in parts else default

        present = F.col(f"n_present_{i}")
        rows.append(
            F.struct(
                F.lit(name).alias("column"),
                F.col("n").alias("count"),
                present.alias("n_present"),
                part("n_number", zero).alias("n_number"),
                part("n_integral", zero).alias("n_integral"),
                part("n_date", present if kind == "date" else zero).alias("n_date"),
                part("n_flag", present if kind == "boolean" else zero).alias("n_flag"),
                part("min", missing).alias("min"),
                part("max", missing).alias("max"),
                part("mean", missing).alias("mean"),
                part("median", missing).alias("median"),
                part("ends", F.lit(None).cast("array<double>")).alias("ends"),
            )
        )
    return prepared.agg(*aggregates).select(F.inline(F.array(*rows)))


def _detected_type() -> Column:
    present = F.col("n_present")
    return (
        F.when(F.col("count") == 0, F.lit("unknown"))
        .when(present == 0, F.lit("empty"))
        .when(F.col("n_integral") == present, F.lit("integer"))
        .when(F.col("n_number") == present, F.lit("float"))
        .when(F.col("n_date") == present, F.lit("date"))
        .when(F.col("n_flag") == present, F.lit("boolean"))
        .otherwise(F.lit("string"))
    )


def infer_column_types(df: DataFrame) -> DataFrame:
    """``column, column_type`` over the whole columns, in the order unknown, empty, integer,
    float, date, boolean, string."""
    profiles = _column_profiles(*_prepare(df), median=None)
    return profiles.select("column", _detected_type().alias("column_type"))


def profile_table(
    df: DataFrame, sample_rows: int | None = None, median: str = "exact"
) -> DataFrame:
    """``column, column_type, count, null_count, min, max, mean, median`` per column.

    Missing means null or empty; the numbers are those of the cells that read as
    numbers. The whole table is profiled unless a sample of rows is asked for.
    ``median``: ``exact`` reads the table a second time, ``approx`` once, ``none`` leaves
    it out.
    """
    if sample_rows is not None:
        df = df.limit(sample_rows)
        median = "sample" if median == "exact" else median
    prepared, kinds = _prepare(df)
    mode = {"exact": "sketch", "none": None}.get(median, median)
    profiles = _column_profiles(prepared, kinds, mode)
    numeric = [(i, n) for i, (n, k) in enumerate(kinds.items()) if k in ("number", "text")]
    if mode == "sketch" and numeric:
        numbers = prepared.select(
            F.inline(
                F.array(
                    *[
                        F.struct(F.lit(n).alias("column"), F.col(f"v{i}").alias("number"))
                        for i, n in numeric
                    ]
                )
            )
        )
        # One row per column of the schema: small enough for every task.
        brackets = F.broadcast(profiles.select("column", "ends", F.col("n_number").alias("n")))
        medians = quantiles.exact_medians(numbers, brackets, ["column"], "number")
        profiles = profiles.drop("median").join(F.broadcast(medians), "column", "left")
    return profiles.select(
        "column",
        _detected_type().alias("column_type"),
        "count",
        (F.col("count") - F.col("n_present")).alias("null_count"),
        "min", "max", "mean", "median",
    )


def column_statistics(
    df: DataFrame, sample_rows: int | None = None, median: str = "exact"
) -> DataFrame:
    """``column, count, null_count, min, max, mean, median``; see ``profile_table``."""
    return profile_table(df, sample_rows, median).drop("column_type")


def file_cells(
    files: DataFrame, content: str = "content", sample_rows: int | None = None
) -> DataFrame:
    """Cells of tabular files held in a column: ``path, column_no, column, row_no, text``.

    ``.json`` files are valid arrays all of whose items are objects; the first one names the
    columns (any other JSON has no cells). ``.csv`` files are cut at commas and others at
    tabs, and their first row names the columns. Row 0 stands for the header, so that a file
    without data rows keeps its columns; a row that is too short has missing cells. All rows
    are read unless a sample is asked for.
    """
    text, suffix = F.col(content), paths.extension(F.col("path"))
    separator = F.when(suffix == ".csv", ",").otherwise("\t")
    is_json = suffix == ".json"
    objects = F.from_json(F.when(is_json & is_record_array(text), text), "array<map<string,string>>")
    cut = files.select(
        "path",
        is_json.alias("is_json"),
        objects.alias("objects"),
        delimited.table_rows(F.when(~is_json, text), separator).alias("table"),
    )
    header = F.when(F.col("is_json"), F.map_keys(F.get("objects", F.lit(0)))).otherwise(F.get("table", F.lit(0)))
    named = cut.withColumn("header", header)
    by_name = F.transform(
        "objects", lambda m: F.transform("header", lambda name: F.try_element_at(m, name))
    )
    body = F.when(F.col("is_json"), by_name).otherwise(F.slice("table", F.lit(2), F.greatest(F.size("table"), F.lit(1))))
    if sample_rows is not None:
        body = F.slice(body, 1, sample_rows)
    blank = F.array(F.lit(None).cast("array<string>"))
    # Outer generators: the plain ones let Spark derive filters that cut the text once more.
    rows = named.select(
        "path", "header", F.posexplode_outer(F.when(F.size("header") > 0, F.concat(blank, body))).alias("row_no", "cells")
    ).where(F.col("row_no").isNotNull())
    return (
        rows.select("path", "row_no", "cells", F.posexplode_outer("header").alias("column_no", "column"))
        .where(F.col("column_no").isNotNull())
        .select(
            "path", "column_no", "column", "row_no", F.get("cells", F.col("column_no")).alias("text")
        )
    )


def is_record_array(text: Column) -> Column:
    """Whether a text is a valid JSON array of one or more objects and nothing else."""
    looks = F.coalesce(text.rlike(r"^\s*\[\s*\{"), F.lit(False))
    return looks & F.when(looks, jt.is_valid_json(text) & (F.array_join(jt.item_types(text), ",") == "object"))


def profile_files(cells: DataFrame) -> DataFrame:
    """One row per file: ``column_count``, ``line_count``, ``row_count``, ``columns``,
    ``column_types`` and ``sample_statistics``.

    Grouped by file and column; a file's cells come from one row of the input, so a
    group is never larger than one file.
    """
    data = F.col("row_no") > 0
    text = F.when(F.col("text") != "", F.col("text"))
    number = F.col("number")
    long = cells.select(
        "path", "column_no", "column",
        data.alias("is_data"), text.alias("text"), values.parse_number(text).alias("number"),
    )
    per_column = (
        long.groupBy("path", "column_no", "column")
        .agg(
            F.count_if("is_data").alias("count"),
            F.count("text").alias("n_present"),
            F.count(number).alias("n_number"),
            F.count_if(values.is_integral(number)).alias("n_integral"),
            F.count_if(values.is_date_text(F.col("text"))).alias("n_date"),
            F.count_if(values.is_boolean_text(F.col("text"))).alias("n_flag"),
            F.min(number).alias("min"),
            F.max(number).alias("max"),
            F.avg(number).alias("mean"),
            F.median(number).alias("median"),
        )
        .withColumn("null_count", F.col("count") - F.col("n_present"))
        .withColumn("column_type", _detected_type())
    )
    statistic = F.struct(*[F.col(n) for n in STATISTICS])
    entry = F.struct("column_no", "column", "column_type", statistic.alias("statistics"))
    per_file = per_column.groupBy("path").agg(
        F.array_sort(F.collect_list(entry)).alias("entries"), F.max("count").alias("row_count")
    )
    by_name = lambda field: F.map_from_entries(
        F.transform("entries", lambda e: F.struct(_unique_name(e), e[field]))
    )
    return per_file.select(
        "path",
        F.size("entries").cast("long").alias("column_count"),
        (F.col("row_count") + 1).alias("line_count"),
        "row_count",
        F.transform("entries", lambda e: e["column"]).alias("columns"),
        by_name("column_type").alias("column_types"),
        by_name("statistics").alias("sample_statistics"),
    )


def _unique_name(entry: Column) -> Column:
    """The column name; repeated names are told apart by their position."""
    same_before = F.filter(
        F.col("entries"),
        lambda o: (o["column"] == entry["column"]) & (o["column_no"] < entry["column_no"]),
    )
    return F.when(F.size(same_before) == 0, entry["column"]).otherwise(
        F.concat(entry["column"], F.lit("#"), entry["column_no"].cast("string"))
    )
