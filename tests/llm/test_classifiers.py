import base64
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import quality as quality_module
from shelfmark.llm.language import (
    LanguageModel,
    family_of,
    gram_counts,
    held_out,
    identify_language,
    keep_identified,
    train_language_model,
)
from shelfmark.llm.quality import fit_ftrl, gram_cells, score_quality, train_quality_model
from shelfmark.llm.words import text_bytes

import pyarrow as pa

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def language(docs):
    return train_language_model(docs, sample_rows=400)


def test_held_out_accuracy_of_languages(docs, language):
    found = identify_language(docs, language).join(docs, "doc_id").filter(held_out(F.col("doc_id")))
    right, n, low, high = found.agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")
    ).first()
    assert n > 150 and right >= 0.98
    assert 0 <= low <= high <= 1


def test_languages_are_told_apart_within_their_family(language):
    assert sorted(language.within) == ["germanic", "romance"]
    assert language.within["germanic"].classes == ["de", "en"]
    assert (family_of("pt-BR"), family_of("xx")) == ("romance", "xx")


def test_texts_of_no_learned_language_are_rejected(spark, docs, language):
    rng = random.Random(4)
    junk = [
        "".join(rng.choice("asdfghjklqwertyuiopzxcvbnm  ") for _ in range(400)),
        "sdkfjh qwpoeiru zmxncbv alskdjf qpwoeiruty",
        base64.b64encode(rng.randbytes(600)).decode(),
        rng.randbytes(300).hex(),
        "это русский текст о погоде и природе " * 5,
    ]
    odd = spark.createDataFrame([(i, t) for i, t in enumerate(junk)], "doc_id long, text string")
    assert keep_identified(odd, language).count() == 0
    # Short and other clean rows stay, also those that were held out.
    plain = docs.filter(F.col("text").rlike(r"^[\p{L} .,\n]+$"))
    assert plain.filter(F.length("text") < 60).count() > 5
    assert keep_identified(plain, language).count() == plain.count()
    assert keep_identified(docs, language).count() >= 0.99 * docs.count()


def test_language_of_odd_rows(edge, nothing, language):
    found = {r["doc_id"]: r for r in identify_language(edge, language).collect()}
    assert {k for k, r in found.items() if r["lang_pred"] == "und" and k is not None} == {20, 21, 22, 28}
    assert found[28]["score"] == 0
    assert identify_language(edge, language).count() == edge.count()
    assert identify_language(nothing, language).count() == 0
    kept = keep_identified(edge, language, min_score=0.0)
    assert kept.columns == edge.columns and kept.count() == edge.count() - 5


@pytest.mark.parametrize("key", [None, 8])
def test_sample_keeps_its_bound_under_one_key(spark, monkeypatch, key):
    seen = []
    monkeypatch.setattr(LanguageModel, "fit", classmethod(lambda cls, x, names: seen.append(names)))
    rows = [(key, f"text number {i}", "en") for i in range(900)] + [(key, "the same", "en")] * 300
    rows += [(i, f"texte {i}", "fr") for i in range(200)]
    train_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=80)
    assert 20 <= seen[0].count("en") <= 50 and 20 <= seen[0].count("fr") <= 50


def test_language_without_labels(spark, edge, nothing):
    assert train_language_model(nothing) is None
    assert {r["lang_pred"] for r in identify_language(edge, None).collect()} == {"und"}
    assert keep_identified(edge, None).count() == edge.count() - 5


def test_prediction_reads_text_alone(docs, language):
    other = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q"))
    assert sorted(map(tuple, identify_language(other, language).collect())) == sorted(
        map(tuple, identify_language(docs, language).collect())
    )


def test_grams_stay_inside_their_text_and_steps_agree():
    raw, offsets = text_bytes(pa.array(["Abc déf", None, "xyz xyz" * 50, ""]))
    whole = gram_counts(raw, offsets)
    alone = [gram_counts(*text_bytes(pa.array([t])))[0] for t in ("abc déf", "", "xyz xyz" * 50, "")]
    assert np.array_equal(whole, np.stack(alone))
    assert np.array_equal(whole, gram_counts(raw, offsets, step=13))


def test_one_language_alone():
    model = LanguageModel.fit(np.ones((3, 4), np.float32), ["en"] * 3)
    assert model.predict(np.ones((2, 4), np.float32))[0] == ["en", "en"]


@pytest.fixture(scope="module")
def quality(spark, docs):
    return train_quality_model(docs, spark.read.parquet(f"{SF}/labels.parquet"))


def test_held_out_accuracy_of_quality(spark, docs, quality):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = score_quality(docs, quality).join(labels, "doc_id").filter(held_out(F.col("doc_id"))).collect()
    good = [r for r in rows if r["quality"] == 1]
    bad = [r for r in rows if r["quality"] == 0]
    assert len(good) > 50 and len(bad) > 5
    assert np.mean([r["predicted"] for r in good]) >= 0.95
    assert np.mean([r["predicted"] for r in bad]) <= 0.2
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_quality_of_odd_rows(edge, nothing, quality):
    rows = score_quality(edge, quality).collect()
    assert len(rows) == edge.count()
    found = {r["doc_id"]: r["score"] for r in rows}
    assert found[20] == found[21] == found[22]  # no words: the bias alone
    assert score_quality(nothing, quality).count() == 0
    assert {r["score"] for r in score_quality(edge, None).collect()} == {0.5}


def test_quality_labels_of_odd_kinds(spark, edge):
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (3, 7, 0)], "doc_id long, quality int, toxic int")
    assert train_quality_model(edge, labels) is None
    model = train_quality_model(edge, spark.createDataFrame([(1, 1, 0), (1, 0, 0), (5, 1, 1)], labels.schema))
    assert model is not None


@pytest.mark.parametrize("copies", [1, 3])
def test_quality_sample_keeps_its_bound_under_one_key(spark, monkeypatch, copies):
    learned = []
    fit = quality_module.fit_ftrl
    monkeypatch.setattr(quality_module, "fit_ftrl", lambda x, y, **kw: learned.append(len(x)) or fit(x, y, **kw))
    key = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 4 != 2)
    rows = [(key, f"word{i} other{i % 7}") for i in range(5000)] + [(i, f"plain text {i}") for i in range(1000, 1200)]
    docs = spark.createDataFrame(rows * copies, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k == key or k % 2)) for k in {r[0] for r in rows}] * copies, "doc_id long, quality int")
    assert train_quality_model(docs, labels, sample_rows=150) is not None
    assert 75 <= learned[0] <= 190


def test_ftrl_separates_and_stays_sparse():
    rng = np.random.default_rng(1)
    examples, labels = [], []
    for i in range(400):
        label = i % 2
        cells = np.unique(np.r_[rng.integers(100, 4000, 20), 7 if label else 9])
        examples.append((cells, np.full(len(cells), 0.5)))
        labels.append(label)
    model = fit_ftrl(examples, labels)
    assert model.weights[7] > 0 > model.weights[9]
    assert (model.weights != 0).sum() < 4000


def test_cells_do_not_depend_on_neighbours():
    raw, offsets = text_bytes(pa.array(["a b b", "", "C!! a", None]))
    cells, first = gram_cells(raw, offsets)
    assert first.tolist() == [0, 12, 12, 20, 20]
    alone, _ = gram_cells(*text_bytes(pa.array(["C!! a"])))
    assert np.array_equal(cells[12:20], alone)
