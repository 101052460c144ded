import random
import re
import tracemalloc

import numpy as np
from llm_samples import prose

from shelfmark.llm import decontaminate as module
from shelfmark.llm.decontaminate import budget, find_leaks, keep_clean


def letters(text):
    return "".join(c for c in (text or "").lower() if c.isalnum())


def best_edits(item, text):
    """Semi-global edit distance by the plain recurrence."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def brute(docs, items, rate=0.1, least=24):
    out = []
    for k, text in docs:
        for name, item in items:
            want = letters(item)
            if len(want) >= least:
                edits = best_edits(want, letters(text))
                if edits <= budget(len(want), rate):
                    out.append((k, name, edits))
    return sorted(out, key=str)


def damaged(text, edits, seed):
    rng, chars = random.Random(seed), list(text)
    for _ in range(edits):
        at, kind = rng.randrange(len(chars)), rng.randrange(3)
        if kind == 0:
            chars[at] = rng.choice("abcxyz")
        elif kind == 1:
            del chars[at]
        else:
            chars.insert(at, rng.choice("abcxyz"))
    return "".join(chars)


ITEMS = [(i, prose(500 + i, 6 + 3 * i)) for i in range(8)] + [(20, "short"), (21, None), (22, ""), (23, prose(503, 15).upper())]
KIND = "item_id long, text string, edits string"


def benchmark(spark, items=ITEMS):
    return spark.createDataFrame([(*r, "clash") for r in items], KIND)


def documents():
    rows = []
    for i in range(60):
        name, item = ITEMS[i % 8]
        size = len(letters(item))
        text = prose(i, 30) + ". " + damaged(item, (i * 7) % (size // 8 + 4), i) + "\n" + prose(i + 99, 20)
        rows.append((i, text if i % 3 else text.upper().replace(" ", " -- ")))
    rows += [(100, None), (101, ""), (102, ITEMS[4][1]), (103, ITEMS[4][1][:-30]), (104, ITEMS[2][1] + " " + ITEMS[5][1]),
             (105, prose(1, 40)), (None, ITEMS[6][1]), (102, ITEMS[4][1])]
    return rows


def test_items_with_edits_against_the_plain_recurrence(spark):
    df = spark.createDataFrame(documents(), "doc_id long, text string").repartition(3)
    got = find_leaks(df, benchmark(spark)).collect()
    assert sorted(((r["doc_id"], r["item_id"], r["edits"]) for r in got), key=str) == brute(documents(), ITEMS)
    assert len({r["edits"] for r in got}) > 4
    texts = dict(documents())
    for r in got:
        if r["edits"] == 0:
            item = letters(dict(ITEMS)[r["item_id"]])
            assert letters(texts[r["doc_id"]][r["start_char"] : r["end_char"]]) == item


def test_several_passes_find_the_same(spark, monkeypatch):
    df = spark.createDataFrame(documents(), "doc_id long, text string")
    want = sorted(map(str, find_leaks(df, benchmark(spark)).collect()))
    monkeypatch.setattr(module, "ITEM_CHARS", 500)
    monkeypatch.setattr(module, "SLICE_CHARS", 700)
    monkeypatch.setattr(module, "_ALIGN_STEP", 1)
    assert sorted(map(str, find_leaks(df, benchmark(spark)).collect())) == want
    hit = {r[0] for r in brute(documents(), ITEMS)}
    kept = keep_clean(df, benchmark(spark))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(k for k, _ in documents() if k not in hit)


def test_rows_of_every_kind(edge, nothing, spark):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect() if len(r["text"] or "") < 10_000]
    items = [(1, " ".join(rows[2][1].split()[5:25])), (2, rows[0][1][:60])]
    got = find_leaks(edge, benchmark(spark, items)).select("doc_id", "item_id", "edits").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, items)
    assert keep_clean(edge, benchmark(spark, items)).columns == edge.columns
    assert find_leaks(nothing, benchmark(spark)).count() == 0
    assert find_leaks(edge, benchmark(spark, [])).count() == 0
    assert keep_clean(edge, benchmark(spark, [])).count() == edge.count()


def test_letters_that_change_length_in_lower_case():
    codes, place, _ = module.Letters().reduce(["İx Ab"])
    assert len(codes) == 4 and place.tolist() == [0, 1, 3, 4] and np.all(codes[1:] == [ord(c) for c in "xab"])


def test_postings_in_small_steps_give_the_same_regions(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(400))) for _ in range(12)] + ["a" * 500, "", "ab" * 200]
    items = module.Items([(i, "".join(rng.choice("ab") for _ in range(30 + 7 * i))) for i in range(9)] + [(9, "a" * 64)], 0.1, 24)
    codes, _, first = module.Letters().reduce(texts)
    whole = module.candidate_regions(items, codes, first)
    assert len(whole) > 50
    for step in (1, 7, 1000):
        monkeypatch.setattr(module, "_POSTINGS", step)
        assert np.array_equal(module.candidate_regions(items, codes, first), whole)


def test_monotonous_texts_and_common_phrases_stay_within_bounded_memory():
    phrase = prose(9, 4)
    cases = [
        (module.Items([(1, "a" * 64)], 0.1, 24), "a" * 200_000),
        (module.Items([(i, f"{phrase} {prose(i, 8)}") for i in range(60)], 0.1, 24), (phrase + " ") * 300),
    ]
    for items, text in cases:
        letters = module.Letters()
        tracemalloc.start()
        found = module.find_items(items, [text], letters)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 300 << 20
        assert [f[:4] for f in found] == ([(0, 1, 0, 0)] if text[0] == text[1] == "a" and len(items.names) == 1 else [])


def test_short_items_are_found_verbatim_as_whole_words(spark):
    rng = random.Random(3)
    words = ["ab", "abc", "c", "xyz", "x", "7", "Abc"]
    texts = [(i, "".join(rng.choice(words) + rng.choice([" ", "-", "", "\n"]) for _ in range(rng.randrange(25)))) for i in range(80)]
    items = [(1, "c"), (2, "abc x"), (3, "X-Y"), (4, "ab abc"), (5, "7"), (6, "--"), (7, "abcx yz x abc"), (8, "ABC X")]
    want = []
    for k, text in texts:
        found = re.findall(r"[a-z0-9]+", text.lower())
        spelt = {"".join(found[i:j]) for i in range(len(found)) for j in range(i + 1, len(found) + 1)}
        want += [(k, name, 0) for name, item in items if letters(item) and letters(item) in spelt]
    got = find_leaks(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), benchmark(spark, items)).collect()
    assert sorted((r["doc_id"], r["item_id"], r["edits"]) for r in got) == sorted(want)
    assert {r["item_id"] for r in got} == {1, 2, 4, 5, 8} and len(want) > 60
    for r in got:
        piece = dict(texts)[r["doc_id"]][r["start_char"] : r["end_char"]]
        assert letters(piece) == letters(dict(items)[r["item_id"]])
