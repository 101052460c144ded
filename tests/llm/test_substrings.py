import random
import re

import numpy as np
import pytest
from llm_samples import prose

from shelfmark.llm import substrings
from shelfmark.llm.substrings import remove_repeats, repeated_in_bucket, without_repeats

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=20):
    order = lambda r: -(2**63) if r[0] is None else r[0]
    first, words = {}, [SPACE.findall(t or "") for _, t in rows]
    for r, w in zip(rows, words):
        for i in range(len(w) - window + 1):
            name = tuple(w[i : i + window])
            first[name] = min(first.get(name, (2**63, 0)), (order(r), i))
    gone = {}
    for r, w in zip(rows, words):
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (order(r), i):
                gone.setdefault(order(r), set()).update(range(i, i + window))
    out = []
    for r, w in zip(rows, words):
        kept = [x for i, x in enumerate(w) if i not in gone.get(order(r), ())]
        out.append((r[0], len(w), len(w) - len(kept), " ".join(kept)))
    return sorted(out, key=str)


def measured(df):
    return sorted(map(tuple, df.collect()), key=str)


def shared_passages(n):
    rng = random.Random(5)
    passage, line = prose(900, 70), prose(901, 20)
    rows = []
    for i in range(n):
        parts = [prose(i, rng.randrange(5, 80))]
        if i % 3 == 0:
            parts += [passage, prose(1000 + i, 8)]
        if i % 5 == 0:
            parts += [line] * rng.randrange(1, 4)
        if i % 7 == 0:
            parts.append(" \t".join(prose(i - 7, 60).split()))
        if i % 11 == 0:
            parts.append("la la " * rng.randrange(10, 200))
        rng.shuffle(parts)
        rows.append((i, "\n".join(parts)))
    return rows


def test_rows_of_every_kind(edge):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert measured(remove_repeats(edge)) == brute(rows)


@pytest.mark.parametrize("window", [20, 7, 3])
def test_passages_shared_by_a_third_of_the_documents(spark, monkeypatch, window):
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(substrings, "FLUSH_BYTES", 30_000)
    monkeypatch.setattr(substrings, "HOT_FACTOR", 0)
    rows = shared_passages(150)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert measured(remove_repeats(df, window=window)) == brute(rows, window)


def test_equal_hashes_of_different_words_are_settled(monkeypatch):
    # All words alike to the hash: only the strings tell the windows apart.
    monkeypatch.setattr(substrings, "hash_words", lambda raw, starts, ends: np.zeros(len(starts), np.uint64))
    texts = ["a b c d", "a b c e", "a b c d", "x a b c"]
    data = np.frombuffer("".join(t + " " for t in texts).encode(), np.uint8)
    key, start, words = np.array([1, 2, 3, 4]), np.zeros(4, np.int64), np.full(4, 4)
    found = sorted(zip(*(x.tolist() for x in repeated_in_bucket(3, key, start, words, data))))
    assert found == [(2, 0, 3), (3, 0, 4), (4, 1, 4)]


def test_whole_rows(edge, nothing):
    changed = without_repeats(edge)
    assert changed.columns == edge.columns and changed.schema == edge.schema
    before = {(r["doc_id"], r["text"]) for r in edge.collect()}
    for r in changed.collect():
        if r["doc_id"] in (4, 9, 24, 25, 26, 27):  # may lose words
            assert r["n_chars"] == len(r["text"])
        elif r["doc_id"] is not None:
            assert (r["doc_id"], r["text"]) in before
    assert without_repeats(nothing).count() == 0 and remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("key", [None, 7])
def test_rows_of_one_key_lose_only_their_own_repeats(spark, key):
    copied, own = prose(50, 60), [prose(60 + i, 80) for i in range(4)]
    texts = [copied + " " + own[0], own[1], copied + " " + own[2], own[3] + " " + copied]
    rows = [(key, t) for t in texts]
    df = spark.createDataFrame([*rows, (9, copied)], "doc_id long, text string").repartition(3)
    kept = [r["kept_text"] for r in remove_repeats(df).collect()]
    assert all(sum(o in t for t in kept) == 1 for o in own)  # no clean text goes
    assert sum(copied in t for t in kept) == 1  # one copy stays, although two begin alike
    assert sum(r["n_removed"] for r in remove_repeats(df).collect()) == 3 * 60


def test_stretches_come_as_one_row_per_document(spark):
    """However many buckets find them, and merged where they touch; they used to be a row each."""
    rows = [(i, prose(i % 10, 400)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = substrings.repeated_spans(df).collect()
    assert sorted(r["_key"] for r in found) == list(range(10, 40))
    assert {(tuple(r["_from"]), tuple(r["_to"])) for r in found} == {((0,), (len(SPACE.findall(rows[0][1])),))}


def test_stretches_of_a_document_are_merged():
    found = np.array([[5, 0, 30, 60], [5, 0, 0, 25], [5, 0, 25, 28], [5, 0, 31, 50], [7, 0, 10, 30], [5, 1, 2, 22]])
    packed = substrings._shares(found, 3)
    assert sum(len(d) for d in packed.column("_data").to_pylist()) == found.astype(np.int64).nbytes
    assert substrings._by_document(found).to_pylist() == [
        {"_key": 5, "_look": 0, "_from": [0, 30], "_to": [28, 60]},
        {"_key": 5, "_look": 1, "_from": [2], "_to": [22]},
        {"_key": 7, "_look": 0, "_from": [10], "_to": [30]},
    ]
    assert substrings._by_document(found[:0]).num_rows == 0
    assert substrings._shares(found[:0], 3).num_rows == 0
