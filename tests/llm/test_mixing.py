import hashlib
import re

import pytest

from shelfmark.llm import mixing
from shelfmark.llm.mixing import mix_sources, take_mix

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    size = lambda t: len(SPACE.findall(t or ""))
    total = {}
    for _, text, source in rows:
        total[source] = total.get(source, 0) + size(text)
    names = sorted((s for s in total if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in total)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full, unit = set(), 0.0
    while True:
        left = 1.5 * sum(total.values()) - sum(2 * total[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        unit = left / open_weight if open_weight else 0.0
        new = {s for s in names if s in full or unit * weight[s] > 2 * total[s]}
        if new == full:
            break
        full = new
    target = {s: 2.0 * total[s] if s in full else unit * weight[s] for s in names}
    look = lambda k: int(hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()[:15], 16)
    out = []
    for s in names:
        copies = int(target[s] // total[s]) if total[s] else 0
        room = target[s] - copies * total[s]
        groups = {}
        for k, text, source in rows:
            if source == s:
                groups.setdefault(look(k), []).append((k, size(text)))
        done, closed = 0, False
        for h in sorted(groups):
            words = sum(n for _, n in groups[h])
            take = not closed and (done + words <= room or done + words - room < room - done)
            closed = closed or done + words > room
            done += words if take else 0
            out += [(k, n, total[s], target[s], n * (copies + take)) for k, n in groups[h]]
    return sorted(out, key=str)


def given(rows):
    return [(r["doc_id"], r["text"], r["source"]) for r in rows]


def measured(df):
    return sorted((tuple(r) for r in df.select("doc_id", "size", "source_size", "target", "taken").collect()), key=str)


def test_rows_of_every_kind(edge):
    assert measured(mix_sources(edge)) == brute(given(edge.collect()))


@pytest.mark.parametrize("small_table", [True, False])
def test_a_source_with_most_rows(spark, monkeypatch, small_table):
    if not small_table:
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    rows = [(i, "w " * (1 + i * 7 % 23), "hot" if i % 3 else f"s{i % 11}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = measured(mix_sources(df))
    assert first == brute(rows)
    assert first == measured(mix_sources(df.repartition(5)))
    by = {}
    for k, size, total, target, taken in first:
        assert taken in (0, size, 2 * size)
        by.setdefault(target, [0, 0])[0] += taken
    for source in {r[2] for r in rows}:
        own = {r[0] for r in rows if r[2] == source}
        taken = sum(r[4] for r in first if r[0] in own)
        target = next(r[3] for r in first if r[0] in own)
        assert abs(taken - target) <= 12


def test_take_mix_keeps_columns(edge):
    rows = take_mix(edge)
    assert {"doc_id", "text", "lang", "score", "_row", "copies", "taken"} <= set(rows.columns)
    assert rows.columns.count("size") == 1
    kept = sorted((r["doc_id"], r["taken"]) for r in rows.collect() if r["taken"] and r["doc_id"] is not None)
    assert kept == sorted((r[0], r[4]) for r in brute(given(edge.collect())) if r[4] and r[0] is not None)


def test_empty_tables(spark, nothing):
    assert mix_sources(nothing).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert measured(mix_sources(blank)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
