"""Stored index entries in fixed buckets of the subject, with numbered manifests.

Entries lie below ``data`` as Parquet, a folder per refresh and bucket. A manifest names the
folder of every bucket that has entries; the newest manifest is the index. A refresh rewrites
the buckets it touches and leaves the others where they are. Manifests are created, never
overwritten, so of two writers that start from the same one the second fails and changes
nothing that readers see.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
_NAME = re.compile(r"(\d{6})\.json$")


class ConcurrentRefreshError(RuntimeError):
    """Another refresh was finished in the meantime; read the index again and repeat."""


def _file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _numbers(spark: SparkSession, index_path: str) -> list[int]:
    fs, folder = _file_system(spark, f"{index_path}/manifest")
    if not fs.exists(folder):
        return []
    names = (_NAME.search(status.getPath().getName()) for status in fs.listStatus(folder))
    return sorted(int(m.group(1)) for m in names if m)


def _manifest(spark: SparkSession, index_path: str, number: int) -> dict:
    lines = spark.read.text(f"{index_path}/manifest/{number:06d}.json", wholetext=True)
    return json.loads(lines.head()["value"])


def _current(spark: SparkSession, index_path: str) -> tuple[int, dict | None]:
    numbers = _numbers(spark, index_path)
    return (numbers[-1], _manifest(spark, index_path, numbers[-1])) if numbers else (0, None)


def _create(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that must not exist yet."""
    fs, file = _file_system(spark, path)
    try:
        out = fs.create(file, False)
    except Exception as problem:
        if fs.exists(file):
            raise ConcurrentRefreshError(path) from problem
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def bucket_of(subject: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(subject.cast("binary")), F.lit(buckets)).cast("int")


def _entries(spark: SparkSession, index_path: str, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(manifest["schema"])
    folders = manifest["folders"]
    wanted = [p for b, p in sorted(folders.items()) if buckets is None or int(b) in buckets]
    if not wanted:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{index_path}/{p}" for p in wanted])


def read_index(spark: SparkSession, index_path: str) -> DataFrame | None:
    """All entries of a stored index, or None where there is none."""
    _, manifest = _current(spark, index_path.rstrip("/"))
    return None if manifest is None else _entries(spark, index_path.rstrip("/"), manifest)


def lookup_entry(spark: SparkSession, index_path: str, subject: str) -> DataFrame | None:
    """The stored entry of a subject; only its bucket is read."""
    _, manifest = _current(spark, index_path.rstrip("/"))
    if manifest is None:
        return None
    bucket = zlib.crc32(subject.encode()) % manifest["buckets"]
    return _entries(spark, index_path.rstrip("/"), manifest, [bucket]).where(F.col("subject") == subject)


def write_buckets(spark: SparkSession, incoming: DataFrame, index_path: str, merge) -> None:
    """Merge incoming entries into the buckets they touch: ``merge(current, incoming)``.

    ``incoming`` is read twice, so it should be a stored table.
    """
    index_path = index_path.rstrip("/")
    number, manifest = _current(spark, index_path)
    buckets = manifest["buckets"] if manifest else BUCKETS
    dealt = incoming.withColumn("__bucket", bucket_of(F.col("subject"), buckets))
    touched = sorted(r[0] for r in dealt.select("__bucket").distinct().collect())  # BUCKETS at most
    merged = incoming if manifest is None else merge(_entries(spark, index_path, manifest, touched), incoming)
    folder = f"data/{uuid.uuid4().hex}"
    (
        merged.withColumn("bucket", bucket_of(F.col("subject"), buckets))
        .write.partitionBy("bucket").parquet(f"{index_path}/{folder}")
    )
    folders = dict(manifest["folders"]) if manifest else {}
    folders.update({str(b): f"{folder}/bucket={b}" for b in touched})
    schema = json.loads(merged.schema.json())
    text = json.dumps({"buckets": buckets, "folders": folders, "schema": schema})
    _create(spark, f"{index_path}/manifest/{number + 1:06d}.json", text)


def clean_up(spark: SparkSession, index_path: str, keep: int = 2) -> int:
    """Delete the manifests before the last ``keep`` and the data that only they name.

    Not while a refresh runs: its data is not named by a manifest yet. Returns the number of
    folders deleted.
    """
    if keep < 1:
        raise ValueError("the newest manifest stays")
    index_path = index_path.rstrip("/")
    numbers = _numbers(spark, index_path)
    kept = {p.split("/")[1] for n in numbers[-keep:] for p in _manifest(spark, index_path, n)["folders"].values()}
    fs, data = _file_system(spark, f"{index_path}/data")
    for n in numbers[:-keep]:
        fs.delete(_file_system(spark, f"{index_path}/manifest/{n:06d}.json")[1], False)
    gone = [s.getPath() for s in fs.listStatus(data) if s.getPath().getName() not in kept] if fs.exists(data) else []
    for path in gone:
        fs.delete(path, True)
    return len(gone)
