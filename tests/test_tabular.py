"""Column types, statistics and medians against brute force, also on skewed columns."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

import shelfmark as sm
from shelfmark.operators import tabular as tb

TYPE_CASES = {
    "integer": ["1", "2.0", "1e3", " 7 ", "1_000"], "float": ["1.5", "2"], "infinite": ["inf", "1", "-Infinity"],
    "nan": ["nan", "1"], "date": ["2020-01-01", "01/02/2020", "01-02-2020", "2020-01-01T10:00:00"],
    "flag": ["yes", "No", "t", "1"], "bits": ["0", "1"], "text": ["2020-01-01", "x"], "suffix": ["1.0d", "2"],
    "hexadecimal": ["0x10", "1"], "empty": ["", None], "words": ["true story", "no"],
}
EXPECTED = {
    "integer": "integer", "float": "float", "infinite": "float", "nan": "float", "date": "date", "flag": "boolean",
    "bits": "integer", "text": "string", "suffix": "string", "hexadecimal": "string", "empty": "empty", "words": "string",
}


@pytest.mark.parametrize("name", sorted(TYPE_CASES))
def test_text_column_types(rows, name):
    df = rows([(v,) for v in TYPE_CASES[name]], "v string")
    assert tb.infer_column_types(df).head()["column_type"] == EXPECTED[name]


def test_typed_columns(spark):
    df = spark.sql(
        "SELECT 1 a, 1.5D b, true c, DATE'2020-01-01' d, TIMESTAMP'2020-01-01 00:00:00' e, array(1) f, "
        "CAST(NULL AS INT) g, 2.50BD h"
    )
    got = {r["column"]: r["column_type"] for r in sm.infer_column_types(df).collect()}
    assert got == dict(a="integer", b="float", c="boolean", d="date", e="date", f="string", g="empty", h="float")


def test_empty_table_is_unknown(rows):
    got = sm.profile_table(rows([], "a string, b int")).collect()
    assert [(r["column"], r["column_type"], r["count"]) for r in got] == [("a", "unknown", 0), ("b", "unknown", 0)]


@pytest.mark.parametrize("shape", ["one value", "a third equal", "even", "odd", "two values", "tiny", "wide range"])
def test_exact_median_matches_brute_force(spark, shape):
    r = random.Random(shape)
    data = {
        "one value": [5.0] * 50_001,
        "a third equal": [7.0] * 20_000 + [r.gauss(0, 100) for _ in range(40_000)],
        "even": [r.random() for _ in range(50_000)],
        "odd": [r.random() for _ in range(50_001)],
        "two values": [1.0] * 25_000 + [2.0] * 25_000,
        "tiny": [3.0, 1.0],
        "wide range": [10 ** r.uniform(-200, 200) for _ in range(30_001)],
    }[shape]
    r.shuffle(data)
    df = spark.createDataFrame([(x,) for x in data], "v double").repartition(16)
    row = sm.column_statistics(df).head()
    assert row["median"] == statistics.median(data)
    assert (row["min"], row["max"], row["count"]) == (min(data), max(data), len(data))


def test_missing_and_number_text(rows):
    row = sm.column_statistics(rows([("1",), ("",), (None,), ("x",), ("4",)], "v string")).head()
    assert (row["count"], row["null_count"], row["min"], row["max"], row["mean"], row["median"]) == (5, 2, 1.0, 4.0, 2.5, 2.5)


def test_median_modes_and_sample(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    assert sm.profile_table(df, median="none").head()["median"] is None
    assert abs(sm.profile_table(df, median="approx").head()["median"] - 499.5) <= 1
    assert sm.profile_table(df, sample_rows=10).head()["count"] == 10


def test_delimited_content(rows):
    files = rows(
        [
            ("/q.csv", 'id,name,v\n1,"a, ""q""",2.5\n2,b\n3,"x\ny",inf\n'),
            ("/t.tsv", "p\tq\n1\t2020-01-01\n0\t\n"), ("/h.csv", "only,header"), ("/d.csv", "x,x\n1,a"), ("/e.csv", ""),
        ],
        "path string, content string",
    )
    cells = tb.file_cells(files)
    texts = {(r["path"], r["row_no"], r["column_no"]): r["text"] for r in cells.collect()}
    assert texts["/q.csv", 1, 1] == 'a, "q"' and texts["/q.csv", 3, 1] == "x\ny" and texts["/q.csv", 2, 2] is None
    got = {r["path"]: r for r in tb.profile_files(cells).collect()}
    q = got["/q.csv"]
    assert (q["column_count"], q["line_count"], q["row_count"], q["columns"]) == (3, 4, 3, ["id", "name", "v"])
    assert q["column_types"] == {"id": "integer", "name": "string", "v": "float"}
    assert q["sample_statistics"]["v"]["null_count"] == 1
    assert got["/t.tsv"]["column_types"] == {"p": "integer", "q": "date"}
    assert got["/h.csv"]["row_count"] == 0 and got["/h.csv"]["column_types"]["only"] == "unknown"
    assert got["/d.csv"]["columns"] == ["x", "x"] and len(got["/d.csv"]["column_types"]) == 2


def test_json_content(rows):
    files = rows(
        [("/a.json", '[{"a":1,"b":"x"},{"a":2.5,"z":1,"b":null}]'), ("/b.json", '{"a":1}'), ("/c.json", "[1]")],
        "path string, content string",
    )
    got = tb.profile_files(tb.file_cells(files)).collect()
    assert [r["path"] for r in got] == ["/a.json"]
    assert got[0]["columns"] == ["a", "b"] and got[0]["column_types"] == {"a": "float", "b": "string"}


def test_read_delimited_and_json_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('p,q\n1,"x, y"\n2,\n')
    (tmp_path / "a.tsv").write_text("p\tq\n1\t2\n")
    (tmp_path / "a.json").write_text('[{"b": 1, "a": "x"}, {"a": "y", "c": 3}]')
    (tmp_path / "b.json").write_text('{"a": 1}')
    assert [tuple(r) for r in sm.read_delimited(spark, str(tmp_path / "a.csv")).collect()] == [("1", "x, y"), ("2", None)]
    assert sm.read_delimited(spark, str(tmp_path / "a.tsv")).columns == ["p", "q"]
    records = sm.read_json_records(spark, str(tmp_path / "a.json"))
    assert records.columns == ["b", "a"] and [tuple(r) for r in records.collect()] == [("1", "x"), (None, "y")]
    with pytest.raises(ValueError):
        sm.read_json_records(spark, str(tmp_path / "b.json"))
    texts = spark.createDataFrame([('[{"a":1}]',), ("[]",), ("{}",)], "content string")
    assert [r["structure"] for r in sm.json_table_summary(texts).collect()] == [None, "non-tabular", "non-tabular"]


def cut(rows, *files):
    return {r["path"]: r for r in tb.profile_files(tb.file_cells(rows(list(files), "path string, content string"))).collect()}


def test_quotes_open_only_where_a_cell_begins(rows):
    got = cut(
        rows,
        ("/a.csv", 'name,n\n5" disk,1\n"a, ""b""\nc",2\n\nplain,3\n'),
        ("/p.csv", "x,y\n\ue000\ue001\ue002,1\n"),
        ("/t.tsv", 'x\ty\na"b\t1\n'),
    )
    assert got["/a.csv"]["row_count"] == 3 and got["/a.csv"]["column_types"] == {"name": "string", "n": "integer"}
    assert (got["/p.csv"]["row_count"], got["/p.csv"]["column_count"]) == (1, 2)
    assert got["/t.tsv"]["column_types"] == {"x": "string", "y": "integer"}


def test_json_tables_are_judged_whole(rows):
    got = cut(
        rows,
        ("/a.json", '[{"a": 1, "b": {"c": [1]}}, {"a": 2}]'), ("/b.json", '[{"a":1},{"a":2}] junk'),
        ("/c.json", '[{"a":1},5,"x"]'), ("/d.json", "[]"), ("/e.json", None), ("/f.csv", ""),
    )
    assert set(got) == {"/a.json"}
    assert (got["/a.json"]["row_count"], got["/a.json"]["columns"]) == (2, ["a", "b"])


def test_limits_that_were_defaults_are_gone(rows, spark):
    import json

    from shelfmark.functions import arrays, json_text

    df = spark.range(1).select(arrays.array_statistics(F.sequence(F.lit(1), F.lit(1500))).alias("s"))
    assert df.head()["s"]["max"] == 1500
    texts = [("[1,2,3,4,5,\"x\",null]",), (json.dumps({f"k{i}": i for i in range(9)}),), ("[" * 1500 + "]" * 1500,),
             ("1" * 1500,), ("[" * 1500,), ("{\"a\": 1",)]
    got = sm.json_profile(rows(texts, "content string")).collect()
    assert got[0]["json_structure"]["sample_item_types"] == ["null", "number", "string"]
    assert len(got[1]["json_structure"]["sample_keys"]) == 9
    assert [r["json_valid"] for r in got] == [True, True, None, None, None, False]
    assert "not judged" in got[2]["json_error"]
    pages = rows([("d", i, "one word") for i in range(12)] + [("e", 1, None)], "doc string, n int, text string")
    stats = {r["doc"]: r for r in sm.page_text_stats(pages, "doc", "n").collect()}
    assert (stats["d"]["word_count"], stats["e"]["word_count"], stats["e"]["text_preview"]) == (24, 0, "")
    leaves = rows([(f"/g/x{i:02}",) for i in range(15)] + [("/a/b/c/d/e/leaf",)], "path string")
    listed = [r["item"] for r in sm.list_hierarchy(leaves).where("type = 'dataset'").collect()]
    assert len(listed) == 16
