import random
import re

import pytest
from llm_samples import prose

from shelfmark.llm import near_duplicates as module
from shelfmark.llm.components import component_roots
from shelfmark.llm.near_duplicates import keep_representatives, near_duplicates

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, words):
    found = SPACE.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not found:
        return frozenset()
    return frozenset(tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1)))


def brute(rows, words):
    order = lambda k: -(2**63) if k is None else k
    sets = [shingles(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 2**63), order(k))
    out = []
    for i, (k, _) in enumerate(rows):
        c = least[find(i)]
        out.append((k, len(sets[i]), None if c == -(2**63) else c, order(k) == c))
    return sorted(out, key=str)


def edited(text, edits, seed):
    rng, words = random.Random(seed), text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def copies(n, size=120, most=14):
    base = prose(77, size)
    return [(10_000 + i, edited(base, i % most, i)) for i in range(n)]


def measured(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("words", [5, 2])
def test_rows_of_every_kind(edge, words):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert measured(near_duplicates(edge, words=words)) == brute(rows, words)


def test_a_large_group_of_copies_and_many_small_ones(spark, monkeypatch):
    monkeypatch.setattr(module, "SMALL_NODE", 6)
    monkeypatch.setattr(module, "CELL", 16)
    rows = [(i, prose(i // 3, 90) if i % 3 else edited(prose(i // 3, 90), i % 5, i)) for i in range(240)]
    rows += copies(150) + [(20_000 + i, prose(5, 90).upper()) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert measured(near_duplicates(df, words=2)) == brute(rows, 2)


def test_pairs_at_the_bound(spark):
    # 20 of 25 shingles shared is exactly 80 per cent; 19 of 25 is not.
    word = [f"w{i}" for i in range(40)]
    a = " ".join(word[:21])
    rows = [(1, a), (2, " ".join(word[:26])), (3, "z " + a + " " + " ".join(word[30:34])), (4, " ".join(word[:27]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert measured(near_duplicates(df, words=2)) == brute(rows, 2)


def test_kept_rows(spark, edge, nothing):
    kept = keep_representatives(edge)
    assert kept.columns == edge.columns
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert 24 not in ids and 3 in ids
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "q")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in keep_representatives(twice).collect()) == [1, 2]
    assert keep_representatives(nothing).count() == 0 and near_duplicates(nothing).count() == 0


def test_components_of_chains_stars_and_cycles(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(100, 100 + i) for i in range(1, 40)] + [(500, 139)]
    cycle = [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(7_000, 7_000)]
    links = spark.createDataFrame(chain + star + cycle, "a long, b long")
    got = {r[0]: r[1] for r in component_roots(links, 200).table.collect()}
    assert got == {i: 0 for i in range(1, 61)} | {100 + i: 100 for i in range(1, 40)} | {500: 100} | {
        200 + i: 200 for i in range(1, 9)
    }
    assert component_roots(links.limit(0), 0).table.count() == 0
    few = {r[0]: r[1] for r in component_roots(links, 10**9).table.collect()}
    assert few == got


def test_chance_of_missing_a_pair_at_every_depth():
    shared, chance = 1.0, [1.0]
    for _ in range(module.DEPTH + module.MORE * module.ROUNDS):
        shared = 1 - 0.75 * (1 - 0.8 * shared) - 0.25 * (1 - 0.8 * shared) ** 2
        chance.append(shared)
    for turn in range(module.ROUNDS + 1):
        assert (1 - chance[module.DEPTH + module.MORE * turn]) ** module.trees_after(turn) < 2e-4


def test_extra_trees_are_drawn_for_large_nodes(spark, monkeypatch):
    drawn = []
    entries = module._entries
    monkeypatch.setattr(module, "SMALL_NODE", 4)
    monkeypatch.setattr(module, "_entries", lambda *a: drawn.append(a[1:]) or entries(*a))
    # Families of one template with several components, none of which has half of a node.
    rows = [(i, edited(prose(500, 100), 4, i // 3) + f" own{i // 3} " * 3 + f"last{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert measured(near_duplicates(df, words=2)) == brute(rows, 2)
    assert (module.DEPTH + module.MORE, range(12, 17)) in drawn


@pytest.mark.parametrize("key", [None, 7])
def test_one_row_of_a_component_stays_under_one_key(spark, key):
    texts = [prose(3, 90), prose(3, 90).upper(), prose(3, 90) + " more", prose(4, 90), "", None]
    df = spark.createDataFrame([(key, t) for t in texts] + [(9, prose(3, 90))], "doc_id long, text string")
    kept = sorted((r["text"] or "").lower()[:200] for r in keep_representatives(df).collect())
    assert kept == ["", "", *sorted([prose(3, 90)[:200], prose(4, 90)[:200]])]


def test_stage_takes_columns_of_any_name(spark):
    rows = [(i, prose(i // 2, 90), i, "x", None) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _gone long, _given string, _key string")
    kept = keep_representatives(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect())) == [r for r in rows if r[0] % 2 == 0]
