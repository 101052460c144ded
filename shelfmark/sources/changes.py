"""What changed in a tree since an earlier listing of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths

ERRORS_BROADCAST = 100_000  # unreadable paths of one listing that are broadcast at most


def _split(listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that were read, and the paths that could not be."""
    if "read_error" not in listing.columns:
        return listing, listing.select("path").limit(0)
    bad = F.col("read_error").isNotNull()
    return listing.where(~bad), listing.where(bad).select("path").distinct()


def _unseen(earlier: DataFrame, errors: DataFrame, root: str) -> DataFrame:
    """Paths of the earlier listing that are, or lie below, a path that cannot be read now."""
    steps = earlier.select("path", F.explode(paths.self_and_ancestors(F.col("path"), root)).alias("step"))
    blocked = errors.select(F.col("path").alias("step"))
    if blocked.count() <= ERRORS_BROADCAST:
        blocked = F.broadcast(blocked)
    return steps.join(blocked, "step", "left_semi").select("path").distinct()


def listing_changes(listing: DataFrame, earlier: DataFrame, root: str = "/") -> DataFrame:
    """The files of two listings of one tree that differ, with ``change`` in front.

    ``added`` and ``changed`` rows (another size or modification time) are those of
    ``listing``, ``removed`` rows those of ``earlier``; columns that only one of them has
    are null in the other's rows. What cannot be read now is not judged: its own path and all below it
    count as unchanged, so a directory that fails once does not remove its files. Rows with
    a ``read_error`` in ``earlier`` count as never seen. Both sides are shuffled once by path.
    """
    now, errors = _split(listing)
    then, _ = _split(earlier)
    known = then.select("path", F.struct("size_bytes", "modified_at").alias("__then"))
    state = F.struct("size_bytes", "modified_at")
    fresh = now.join(known, "path", "left").withColumn(
        "change",
        F.when(F.col("__then").isNull(), "added").when(~state.eqNullSafe(F.col("__then")), "changed"),
    )
    gone = then.join(now.select("path"), "path", "left_anti")
    gone = gone.join(_unseen(gone, errors, root), "path", "left_anti").withColumn("change", F.lit("removed"))
    found = fresh.where(F.col("change").isNotNull()).drop("__then").unionByName(gone, allowMissingColumns=True)
    return found.select("change", *[c for c in found.columns if c != "change"])


def next_listing(listing: DataFrame, earlier: DataFrame, root: str = "/") -> DataFrame:
    """The listing to compare the next one with: what was read now, and the earlier rows of
    what could not be."""
    now, errors = _split(listing)
    then, _ = _split(earlier)
    kept = then.join(now.select("path"), "path", "left_anti")
    kept = kept.join(_unseen(kept, errors, root), "path", "left_semi")
    return now.unionByName(kept, allowMissingColumns=True)
