"""Text profile against a brute-force checker."""

import re
from collections import Counter

import pytest

import shelfmark as sm
from shelfmark import fixed_values as fixed
from shelfmark.functions import text as tf
from pyspark.sql import functions as F


def brute(text, k=10):
    tokens = re.findall(r"\b\w+\b", text.lower())
    counts = Counter(w for w in tokens if len(w) >= 3 and w not in fixed.STOP_WORDS)
    hits = {c: sum(w in known for w in tokens) for c, known in fixed.LANGUAGE_WORDS.items()}
    best = max(hits.values())
    winners = [c for c, n in hits.items() if n == best]
    return {
        "line_count": text.count("\n") + 1,
        "word_count": len(re.findall(r"\b\w+\b", text)),
        "char_count": len(text),
        "language": winners[0] if len(winners) == 1 else "unknown",
        "keywords": [w for w, _ in counts.most_common(k)],
        "content_preview": text[:1000],
    }


TEXTS = [
    "", "the", "a b c", "tie one two three one two three", "le la est et the and is in",
    "El niño y la niña, que está en la casa de él.\nPor qué", "x" * 1001, "snake_case 42 4242 ab12 ab12",
    "İstanbul İSTANBUL", "漢字かな 漢字かな word", "one\n\n\ntwo\n", "word " * 500 + "other " * 499,
    " ".join(f"w{i:03d}" for i in range(50)) + " w049 w000 w030 w030",
    "don't stop-me now... now? NOW! Don't",
]


def test_profile_matches_brute_force(rows):
    df = rows(list(enumerate(TEXTS)), "id int, content string")
    for r in sm.text_profile(df).collect():
        expected = brute(r["content"])
        assert {n: r[n] for n in expected} == expected, r["content"][:40]


@pytest.mark.parametrize("k", [1, 3, 200])
def test_keyword_limit(rows, k):
    df = rows(list(enumerate(TEXTS)), "id int, content string")
    got = df.select("content", tf.keywords(tf.lower_words(F.col("content")), k).alias("w")).collect()
    assert all(r["w"] == brute(r["content"], k)["keywords"] for r in got)


def test_whole_text_by_default_and_prefix_on_request(rows):
    df = rows([(1, "a " * 10_000 + "zebra zebra")], "id int, content string")
    whole, prefix = sm.text_profile(df).head(), sm.text_profile(df, max_chars=10_000).head()
    assert whole["keywords"] == ["zebra"] and whole["char_count"] == 20_011
    assert prefix["keywords"] == [] and prefix["char_count"] == 10_000


def test_null_text_gives_null(rows):
    r = sm.text_profile(rows([(1, None)], "id int, content string")).head()
    assert r["line_count"] is None and r["keywords"] is None and r["language"] is None


def test_decoding(rows):
    raw = rows([(b"a\r\nb\rc\xff\xfed",)], "content binary")
    assert sm.read_text_content(raw).head()["content"] == "a\nb\nc��d"


def test_profile_needs_no_shuffle(rows):
    plan = sm.text_profile(rows([(1, "x")], "id int, content string"))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan.split("Physical Plan")[1]


@pytest.mark.parametrize("bound", [64, 0])
def test_keywords_over_rows_of_a_key_and_one_shuffle_of_texts(spark, monkeypatch, bound):
    """Counted words used to be shuffled even where no key repeats, at several times the text."""
    from shelfmark.operators import text as operator

    monkeypatch.setattr(operator, "ROWS_OF_A_KEY", bound)
    rows = [("a", "walrus walrus tiger\nzebra tiger walrus"), ("b", "tiger\n\nzebra zebra"), (None, "lonely"), ("c", None)]
    df = spark.createDataFrame(rows, "path string, content string")
    found = sm.extract_keywords(df, "path")
    expected = [("a", 1, "walrus"), ("a", 2, "tiger"), ("a", 3, "zebra"), ("b", 1, "zebra"), ("b", 2, "tiger"), (None, 1, "lonely")]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange ") == (1 if bound else 2)
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    twice = sm.extract_keywords(df.unionByName(df), "path")
    assert sorted(map(tuple, twice.collect()), key=str) == sorted(expected, key=str)
