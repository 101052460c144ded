import corpus_pipeline
import pytest
import test_decontaminate
import test_mixing
import test_near_duplicates
import test_substrings
from llm_samples import SCHEMA, edge_rows, prose
from pyspark.sql import functions as F

from shelfmark.llm.language import train_language_model, identify_language

BENCHMARK = [(1, prose(700, 20)), (2, prose(2, 60)[50:250]), (3, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = edge_rows()
    for i in range(40, 70):
        text = prose(i, 80) + " " + prose(800, 55) + (" " + prose(700, 20) if i % 10 == 0 else "")
        rows.append((i, text, "en" if i % 2 else "fr", f"s{i % 4}", len(text), 0.5, 7, "x"))
    rows += [(100 + i, test_near_duplicates.edited(prose(41, 200), i, i), "en", "s1", 1, 0.5, 7, "x") for i in range(4)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(BENCHMARK, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=str)


def test_every_stage_on_what_the_one_before_kept(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "substring_dedup", "decontaminate", "mix"]

    kept = stages["language_id"](spark, docs, folder).cache()
    judged = identify_language(docs, train_language_model(docs))
    assert ids(kept) == ids(judged.filter((F.col("lang_pred") != "und") & (F.col("score") >= 0.25)))
    assert kept.columns == docs.columns and not {20, 21, 22, 28} & set(ids(kept))

    alone = stages["near_dedup"](spark, kept, folder).cache()
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    stay = {r[0] for r in test_near_duplicates.brute(rows, 5) if r[3]}
    assert {k for k in ids(alone) if k is not None} == {k for k in stay if k is not None}
    assert alone.columns == docs.columns

    cleaned = stages["substring_dedup"](spark, alone, folder).cache()
    rows = [(r["doc_id"], r["text"]) for r in alone.collect()]
    before = dict(rows)
    expected = {r[0]: r[3] if r[2] else before[r[0]] for r in test_substrings.brute(rows)}
    assert {r["doc_id"]: r["text"] for r in cleaned.collect()} == expected
    assert sum(prose(800, 55) in (t or "") for t in expected.values()) == 1

    safe = stages["decontaminate"](spark, cleaned, folder).cache()
    rows = [(r["doc_id"], r["text"]) for r in cleaned.collect()]
    short = [r for r in rows if len(r[1]) < 10_000]
    hit = {r[0] for r in test_decontaminate.brute(short, BENCHMARK)}
    assert hit and ids(safe) == sorted((k for k, _ in rows if k not in hit), key=str)

    taken = stages["mix"](spark, safe, folder)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in safe.collect()]
    want = [(r[0], r[4]) for r in test_mixing.brute(rows) if r[4]]
    got = [(r["doc_id"], r["taken"]) for r in taken.filter("taken > 0").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sorted(got, key=str) == sorted(
        ((r["doc_id"], r["taken"]) for r in corpus_pipeline.run(spark, folder).filter("taken > 0").collect()), key=str
    )


def test_empty_documents(spark, folder, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(BENCHMARK, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
