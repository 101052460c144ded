"""Combine profile outputs into one record and report what failed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def merge_profiles(
    df: DataFrame, profiles: Sequence[str], skip: Sequence[str] = ("error",)
) -> DataFrame:
    """Lift the fields of profile structs to the top level; later profiles win.

    ``profiles`` names struct columns in merge order. A field that several of them have
    takes the last value that is there; a column the row already has is the first
    candidate. Fields of ``file`` are protected: profiles only add what it lacks.
    Profiles are columns of one row, so merging needs no join.
    """
    fields: dict[str, list] = {}
    file_fields: dict[str, list] = {}
    for profile in profiles:
        struct = df.schema[profile].dataType
        if not isinstance(struct, T.StructType):
            raise TypeError(f"profile column {profile!r} is not a struct")
        for name in struct.fieldNames():
            if name in skip:
                continue
            if name == "file" and isinstance(struct[name].dataType, T.StructType):
                for inner in struct[name].dataType.fieldNames():
                    file_fields.setdefault(inner, []).append(F.col(f"{profile}.file.{inner}"))
            else:
                fields.setdefault(name, []).append(F.col(profile).getField(name))

    merged = {}
    for name, values in fields.items():
        candidates = list(reversed(values))
        if name in df.columns and name not in profiles:
            candidates.append(F.col(name))
        merged[name] = F.coalesce(*candidates)
    if "file" in df.columns:
        own = df.schema["file"].dataType.fieldNames()
        added = [
            F.coalesce(*reversed(values)).alias(name)
            for name, values in file_fields.items()
            if name not in own
        ]
        if added:
            merged["file"] = F.struct(*[F.col(f"file.{n}").alias(n) for n in own], *added)
    return df.withColumns(merged)


def extraction_errors(df: DataFrame, profiles: Sequence[str], key: str = "path") -> DataFrame:
    """One row per failed profile of a file: key, profile, message."""
    failures = F.array(
        *[
            F.struct(F.lit(p).alias("profile"), F.col(p).getField("error").alias("error"))
            for p in profiles
        ]
    )
    failed = F.filter(failures, lambda f: f["error"].isNotNull())
    return df.select(F.col(key), F.inline(failed))


def count_errors(errors: DataFrame) -> DataFrame:
    """Failed files per profile."""
    return errors.groupBy("profile").agg(F.count("*").alias("n_failed"))
