"""Profiles of pages, pixels and arrays in the records of their files."""

import json

import pytest
from pyspark.sql import functions as F

import shelfmark as sm

BOXES = {
    "full.json": {"pages": ["one two", None, "three"], "width": 2, "height": 1, "pixels": [[0, 0, 0], [255, 255, 255]],
                  "arrays": {"a": [1.0, 2.0, None], "b": [], "c": [-3.5]}},
    "pages.json": {"pages": ["x y"], "extra": {"deep": [1]}},
    "empty.json": {"pages": [], "pixels": [], "arrays": {}},
    "other.json": [1, 2],
}


@pytest.fixture
def tree(tmp_path):
    for name, value in BOXES.items():
        (tmp_path / name).write_text(json.dumps(value))
    (tmp_path / "broken.json").write_text('{"pages": ["never closed"')
    (tmp_path / "plain.txt").write_text("some words")
    return str(tmp_path)


def test_records_from_files_carry_all_children(spark, tree):
    catalog = sm.build_catalog(spark, tree, containers=[".json"], tabular=False)
    got = {r["path"].rsplit("/", 1)[1]: r for r in catalog.collect()}
    assert set(got) == {*BOXES, "broken.json", "plain.txt"}
    full = got["full.json"]
    assert full["pages"].asDict() == {"page_count": 3, "text_preview": "one two\n\nthree\n\n", "word_count": 3, "char_count": 16}
    assert full["image"]["hex"] == "#808080" and full["image"]["pixel_count"] == 2
    assert [tuple(d) for d in full["image"]["dominant"]] == [("#000000", 50.0), ("#ffffff", 50.0)]
    assert full["arrays"].asDict() == {
        "total_datasets": 3, "total_elements": 4, "total_size_bytes": 32, "min": -3.5, "max": 2.0, "mean": -0.5 / 3
    }
    assert got["pages.json"]["pages"]["word_count"] == 2
    assert got["pages.json"]["image"] is None and got["pages.json"]["arrays"] is None
    for name in ("empty.json", "other.json", "broken.json", "plain.txt"):
        assert (got[name]["pages"], got[name]["image"], got[name]["arrays"]) == (None, None, None)
    assert got["plain.txt"]["word_count"] == 2 and got["full.json"]["json_valid"]


def test_child_tables_given_by_the_caller(spark, rows):
    record = rows([("/a", 1), ("/b", 2), (None, 3), ("/a", 4)], "path string, n int")
    pages = rows([("/a", 2, "y"), ("/a", 1, "x"), (None, 1, "lost")], "path string, page_no int, text string")
    merged = sm.merge_children(record, {"pages": sm.page_profile(pages)}).orderBy("n").collect()
    assert [r["pages"] and r["pages"]["text_preview"] for r in merged] == ["x\n\ny\n\n", None, None, "x\n\ny\n\n"]
    with pytest.raises(ValueError):
        sm.merge_children(record, {"n": sm.page_profile(pages, "n")})
    nothing = sm.merge_children(record, {"pages": sm.page_profile(pages.limit(0))})
    assert nothing.where("pages IS NOT NULL").count() == 0


def test_pixels_and_arrays_of_odd_kinds(spark, rows):
    pixels = rows([("/a", 3, 1, 10, 20, None), ("/a", 3, 1, 10, 20, 30), (None, 1, 1, 1, 1, 1)],
                  "path string, width int, height int, r int, g int, b int")
    (image,) = sm.colour_profile(pixels).collect()
    assert image["path"] == "/a" and image["image"]["hex"] == "#0a141e" and image["image"]["aspect_ratio"] == 3.0
    arrays = rows([("/a", "x", [float("nan"), None]), ("/a", "y", None), ("/b", "z", [1.0, float("inf")])],
                  "path string, name string, values array<double>")
    got = {r["path"]: r["arrays"] for r in sm.array_profile(arrays).collect()}
    assert (got["/a"]["total_datasets"], got["/a"]["total_elements"], got["/a"]["mean"]) == (1, 2, None)
    assert got["/b"]["max"] == float("inf")


def test_profiles_are_not_shuffled_again(spark, rows):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        record = spark.range(100).select(F.concat(F.lit("/"), "id").alias("path"))
        values = record.select("path", F.lit("n").alias("name"), F.array(F.lit(1.0)).alias("values"))
        more = {n: sm.array_profile(values.where(F.col("path") != n), n) for n in ("x", "y", "z")}
        merged = sm.merge_children(record, more)
        plan = merged._jdf.queryExecution().executedPlan().toString()
        # One exchange of the record, one of each child table towards its aggregation.
        assert plan.count("Exchange hashpartitioning") == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
