"""Entries of a searchable index: build, validate, upsert, batch and delete by subject."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import BATCH_SIZE, PUBLIC, SUBJECT_PREFIX


def to_entries(
    catalog: DataFrame,
    prefix: str = SUBJECT_PREFIX,
    visible_to: Sequence[str] | Column | None = None,
    key: str = "path",
) -> DataFrame:
    """``subject, visible_to, content``: one entry per catalog row.

    ``visible_to`` is a list for all rows or an array column; missing or empty means
    public.
    """
    public = F.array(F.lit(PUBLIC))
    if visible_to is None or isinstance(visible_to, (list, tuple)):
        principals = F.array(*[F.lit(p) for p in (visible_to or [PUBLIC])])
    else:
        principals = F.when(F.size(visible_to) > 0, visible_to).otherwise(public)
    return catalog.select(
        F.concat(F.lit(prefix), F.col(key)).alias("subject"),
        principals.alias("visible_to"),
        F.struct(*[F.col(f"`{c}`") for c in catalog.columns]).alias("content"),
    )


def is_publishable() -> Column:
    """An entry needs a subject."""
    return F.coalesce(F.col("subject") != "", F.lit(False))


def publish_summary(entries: DataFrame) -> DataFrame:
    """One row: how many entries can be published and how many cannot."""
    return entries.agg(
        F.count_if(is_publishable()).alias("succeeded"),
        F.count_if(~is_publishable()).alias("failed"),
    )


def latest_per_key(
    df: DataFrame, key: str | Sequence[str], order_by: Sequence[str] = ()
) -> DataFrame:
    """One row per key, the last by ``order_by``; ties are settled by a hash of the row.

    Without an order the hash alone decides: which copy stays is repeatable, but not "the
    last", as rows of a table have no order.

    An aggregate rather than a window: copies of one key are combined on the map side,
    so a key with very many copies never meets in one task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*[F.col(c) for c in order_by], F.xxhash64(F.to_json(F.struct(*rest))))
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__last"))
    return last.select(*keys, "__last.*").select(*df.columns)


def upsert_entries(
    current: DataFrame,
    incoming: DataFrame,
    key: str = "subject",
    order_by: Sequence[str] = (),
    incoming_is_unique: bool = False,
) -> DataFrame:
    """``current`` with ``incoming`` on top: a new entry replaces the old one of its key.

    Repeated incoming keys are reduced first (see ``latest_per_key``) unless the caller
    vouches for them. Only the keys of ``incoming`` take part in the join, so a small
    update of a large index is decided by size to be broadcast and the index is not moved.
    """
    new = incoming if incoming_is_unique else latest_per_key(incoming, key, order_by)
    kept = current.join(incoming.select(key).distinct(), key, "left_anti")
    return kept.select(*current.columns).unionByName(new, allowMissingColumns=True)


def delete_entries(entries: DataFrame, subjects: DataFrame, key: str = "subject") -> DataFrame:
    """The entries whose key is not among ``subjects``."""
    return entries.join(subjects.select(key).distinct(), key, "left_anti").select(*entries.columns)


def batch_entries(
    entries: DataFrame,
    n: int = BATCH_SIZE,
    key: str = "subject",
    buckets: int | None = None,
    rows_per_bucket: int = 100_000,
) -> DataFrame:
    """Add ``bucket`` and ``batch_no``: at most ``n`` entries share both.

    Keys are spread over buckets by digest and numbered within their bucket, so numbering
    is repeatable and no task numbers more than a bucket. The number of buckets follows
    the number of entries unless it is given; at most one batch per bucket is not full.
    """
    order = Window.partitionBy("bucket").orderBy(key)
    return _bucketed(entries, key, buckets, rows_per_bucket).withColumn(
        "batch_no", F.floor((F.row_number().over(order) - 1) / n).cast("long")
    )


def number_batches(
    entries: DataFrame, n: int = BATCH_SIZE, key: str = "subject", rows_per_bucket: int = 100_000
) -> DataFrame:
    """Add ``batch_no``, dense over all entries: only the last batch has fewer than ``n``.

    Entries are ordered by digest bucket, then key. Buckets are counted in one pass; the sums
    of the buckets before each, one row a bucket, are added to the places within it, so no
    task orders more than a bucket and numbers are repeatable for unique keys. Null keys come
    last, as a bucket of their own; no entries give no rows.
    """
    dealt = _bucketed(entries.select(F.struct("*").alias("_entry"), F.col(key).alias("_key")), "_key", None, rows_per_bucket)
    dealt = dealt.withColumn("bucket", F.coalesce("bucket", F.lit(2**62)))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("bucket").agg(F.count("*").alias("_n")).select(
        "bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("_key")) - 1
    numbered = dealt.withColumn("_place", place).join(before, "bucket")
    batch = F.floor((F.col("_before") + F.col("_place")) / n).cast("long").alias("batch_no")
    return numbered.select("_entry.*", batch)


def _bucketed(entries: DataFrame, key: str, buckets: int | None, rows_per_bucket: int) -> DataFrame:
    """Add ``bucket`` by the digest of the key; their number follows the entries unless given."""
    digest = F.conv(F.substring(F.md5(F.col(key)), 1, 8), 16, 10).cast("long")
    if buckets is None:
        counted = entries.agg(F.ceil(F.count("*") / rows_per_bucket).alias("n"))
        number = F.greatest(F.lit(1).cast("long"), counted.scalar())
    else:
        number = F.lit(buckets).cast("long")
    return entries.withColumn("bucket", F.pmod(digest, number))


def index_stats(entries: DataFrame) -> DataFrame:
    """One row: number of entries and bytes of their JSON form."""
    size = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in entries.columns])))
    return entries.agg(
        F.count("*").alias("doc_count"),
        F.coalesce(F.sum(size), F.lit(0)).alias("index_size_bytes"),
    )
