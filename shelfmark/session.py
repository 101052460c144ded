"""Session settings the operators are written for."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

# Semantics (time zone, duplicate JSON keys) and adaptive execution. Sizes such as the
# number of shuffle partitions belong to the cluster and are not set here.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the recommended settings to an existing session."""
    for key, value in RECOMMENDED_CONF.items():
        spark.conf.set(key, value)
    return spark


def wide(spark: SparkSession) -> int:
    """Tasks for work that is dear for its size: several a core, and no fewer than shuffles have.

    As a given number it also holds where Spark would join small partitions.
    """
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


_private_folders: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; a private folder is made only
    where nothing is set and Spark runs on one machine, as in tests. Elsewhere a missing
    setting is an error: executors would write to disks that others do not see.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not folder:
        application = spark.sparkContext.applicationId
        if application not in _private_folders:
            _private_folders[application] = tempfile.mkdtemp(prefix="shelfmark-")
        folder = _private_folders[application]
    return folder.rstrip("/")
