"""Line ends inside quoted cells, with file splits at every place."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

import shelfmark as sm
from shelfmark.sources import quoted


def by_reader(text, separator):
    """Records as the standard library sees them, blank lines left out."""
    return [r for r in csv.reader(io.StringIO(text.replace("\r\n", "\n"), newline=""), delimiter=separator) if r]


def adversarial(seed, rows=120):
    rng = random.Random(seed)
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(["a", "b", "c"])
    pieces = ["x", '"', '""', "\n", ",", "long " * 9, "", "é", "\n\n", '"\n"', "1"]
    for _ in range(rows):
        cells = ["".join(rng.choice(pieces) for _ in range(rng.randrange(6))) for _ in range(3)]
        writer.writerow(["k", *cells[1:]])
    return out.getvalue()


@pytest.fixture
def small_splits(spark):
    changed = {"spark.sql.files.maxPartitionBytes": "61", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("bound", [500_000, 0])
def test_equal_to_a_reader_of_the_whole_text(spark, tmp_path, small_splits, monkeypatch, bound):
    monkeypatch.setattr(quoted, "BLOCKS_BROADCAST", bound)
    for seed in range(2):
        text = adversarial(seed)
        (tmp_path / f"t{seed}.csv").write_text(text)
    got = quoted.quoted_records(spark, str(tmp_path), ",")
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 50
    records = {}
    for r in got.collect():
        records.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["is_first"], r["text"]))
    for seed in range(2):
        mine = records[f"t{seed}.csv"]
        assert [by_reader(t, ",")[0] for first, t in mine if first] == [["a", "b", "c"]]
        parsed = sorted(by_reader(t, ",")[0] for first, t in mine if not first and t)
        assert parsed == sorted(by_reader(adversarial(seed), ",")[1:])


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_cells_equal_a_one_task_parse(spark, tmp_path, small_splits, end):
    path = tmp_path / "rows.csv"
    path.write_bytes(adversarial(7).replace("\n", end).encode())
    got = sm.read_delimited(spark, str(path), multi_line=True)
    assert got.columns == ["a", "b", "c"]
    assert sorted(tuple(v or "" for v in r) for r in got.collect()) == sorted(
        map(tuple, by_reader(adversarial(7), ",")[1:])
    )
    if end == "\n":
        want = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(str(path))
        assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_open_cell_at_the_end_quotes_inside_cells_and_empty_files(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_text('h,i\n5" pipe,"x\ny"\nz,"open\n' + "tail,\n" * 30)
    (tmp_path / "b.csv").write_text("")
    (tmp_path / "c.csv").write_text('"h\n1",i\n1,2\n\n3,4\n')
    got = quoted.quoted_records(spark, str(tmp_path), ",").groupBy("file").agg(
        F.sort_array(F.collect_list("text")).alias("t"), F.count_if("is_first").alias("n")
    )
    found = {r["file"][-5:]: (r["t"], r["n"]) for r in got.collect()}
    assert found["a.csv"] == (sorted(["h,i", '5" pipe,"x\ny"', 'z,"open\n' + "\n".join(["tail,"] * 30)]), 1)
    assert found["c.csv"] == (sorted(['"h\n1",i', "1,2", "", "3,4"]), 1)
    assert "b.csv" not in found


def test_the_query_writes_its_files_without_bringing_rows_together(spark, tmp_path, monkeypatch):
    """All rows used to be dealt to two tasks, whatever their number."""
    from catalog_queries import profile_queries

    made = spark.createDataFrame([(i, "s", f'a "{i}"\nb, c') for i in range(60)], "doc_id long, source string, text string")
    made.repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(profile_queries, "work_dir", lambda spark: str(tmp_path / "work"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "2000")
    try:
        got = profile_queries.read_delimited_quoted(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(r["doc_id"] for r in got) == list(range(60))
    assert sorted(r["n_chars"] for r in got) == sorted(len(f'a "{i}"\nb, c') for i in range(60))
    assert len(list((tmp_path / "work").glob("*/documents.csv/part-*"))) > 2
