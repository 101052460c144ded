import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shelfmark.llm.token_counts import TokenCounter, count_tokens, merged_length, merged_lengths

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = TokenCounter(PATH, kept=500)


def by_library(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_counts_as_in_the_library(text):
    assert COUNTER.count([text]) == [by_library(text)]


def test_special_strings_runs_and_long_texts():
    texts = ["<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "a" * 4999, "ab" * 3000, "  \n\n  x", "", "I'll 'tis we've"]
    texts += ["word " * 50_000 + "<|endoftext|>" + "tail"]
    small = TokenCounter(PATH, text_chars=10_000)
    assert small.count(texts) == [by_library(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab eést\n<|", max_size=80))
def test_long_sequences_merge_as_short_ones_do(text):
    piece = text.encode()
    if len(piece) > 1:
        assert merged_length(COUNTER.table, piece) == merged_lengths(COUNTER.table, [piece])[0]


def test_very_long_pre_tokens():
    rng = random.Random(1)
    texts = ["".join(rng.choices("etaoinshrdlu", k=60_000)), "a" * 30_001, "the" * 9_000, "é" * 5_000]
    texts.append(" ".join([texts[0][:20_000], "short", texts[2]]))
    assert COUNTER.count(texts) == [by_library(t) for t in texts]


def test_rows_of_every_kind(edge):
    got = sorted(map(tuple, count_tokens(edge, PATH).collect()), key=str)
    expected = sorted(
        (
            (r["doc_id"], len((r["text"] or "").encode()), by_library(r["text"] or ""), by_library(r["text"] or "") > 512)
            for r in edge.collect()
        ),
        key=str,
    )
    assert got == expected


def test_empty_table(nothing):
    result = count_tokens(nothing, PATH)
    assert result.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert result.count() == 0


@pytest.mark.parametrize("limit", [0, 3])
def test_limit_is_exclusive(spark, limit):
    text = spark.createDataFrame([(1, " the" * 3)], "doc_id long, text string")
    assert count_tokens(text, PATH, limit=limit).first()["over_limit"] is (limit == 0)
