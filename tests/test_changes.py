"""Second scans against the first."""

import os

import pytest

import shelfmark as sm
from pyspark.sql import functions as F
from shelfmark.sources import changes


def test_changes_of_a_real_tree(spark, tmp_path):
    for name in ("same", "grown", "touched", "gone", "deep/gone", "deep/same"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("text")
        os.utime(tmp_path / name, (1_600_000_000, 1_600_000_000))
    root = str(tmp_path)
    first = sm.scan_files(spark, root)
    assert first.count() == 6
    (tmp_path / "grown").write_text("more text")
    os.utime(tmp_path / "grown", (1_600_000_000, 1_600_000_000))
    os.utime(tmp_path / "touched", (1_600_000_001, 1_600_000_001))
    (tmp_path / "gone").unlink()
    (tmp_path / "deep/gone").unlink()
    (tmp_path / "new").mkdir()
    (tmp_path / "new/file").write_text("")
    second = sm.scan_files(spark, root)
    got = {r["path"][len(root) + 1:]: (r["change"], r["size_bytes"]) for r in sm.listing_changes(second, first, root).collect()}
    assert got == {"grown": ("changed", 9), "touched": ("changed", 4), "gone": ("removed", 4),
                   "deep/gone": ("removed", 4), "new/file": ("added", 0)}
    assert sm.listing_changes(second, second, root).count() == 0
    assert sm.next_listing(second, first, root).count() == second.count()
    everything = sm.listing_changes(second, first.limit(0), root)
    assert {r["change"] for r in everything.collect()} == {"added"} and everything.count() == second.count()


@pytest.mark.parametrize("bound", [100_000, 0])
def test_what_cannot_be_read_is_not_judged(spark, monkeypatch, bound):
    monkeypatch.setattr(changes, "ERRORS_BROADCAST", bound)
    kind = "path string, size_bytes long, modified_at timestamp, read_error string"
    first = spark.createDataFrame(
        [("/r/a/x", 1, None, None), ("/r/a/b/y", 2, None, None), ("/r/ab/z", 3, None, None), ("/r/f", 4, None, None),
         ("/r/broken", None, None, "OSError"), ("/r/kept", 5, None, None)], kind)
    second = spark.createDataFrame(
        [("/r/a", None, None, "PermissionError"), ("/r/f", None, None, "OSError"), ("/r/broken", 7, None, None),
         ("/r/kept", 5, None, None)], kind)
    got = {(r["change"], r["path"]) for r in sm.listing_changes(second, first, "/r").collect()}
    assert got == {("removed", "/r/ab/z"), ("added", "/r/broken")}
    following = sm.next_listing(second, first, "/r")
    assert {r["path"] for r in following.collect()} == {"/r/a/x", "/r/a/b/y", "/r/f", "/r/broken", "/r/kept"}


def test_contents_are_read_by_many_tasks(spark, tmp_path):
    """A listing is one small file, and its one task used to read all contents."""
    for i in range(64):
        (tmp_path / f"f{i}.txt").write_text(f"text {i}")
    files = sm.scan_files(spark, str(tmp_path), with_content=True)
    read = files.select("filename", F.col("content").cast("string").alias("text"), F.spark_partition_id().alias("task")).collect()
    assert {(r["filename"], r["text"]) for r in read} == {(f"f{i}.txt", f"text {i}") for i in range(64)}
    tasks = [r["task"] for r in read]
    assert max(map(tasks.count, tasks)) <= 8
