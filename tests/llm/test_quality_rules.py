import re
from collections import Counter

import pytest

from llm_samples import prose
from shelfmark.llm.quality_rules import RULES, STOP_WORDS, Rule, judge_quality

KNOWN = {w for s in STOP_WORDS for w in (s, s[:1].upper() + s[1:])}


def brute_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    return {
        "n_words": len(words),
        "n_stop_words": sum(w in KNOWN for w in words),
        "n_repeat_words": len(covered),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_bullet_lines": sum(s.lstrip(" ")[:1] in ("-", "*", "•") for s in lines),
        "n_ellipsis_lines": sum(s.rstrip(" ").endswith(("...", "…")) for s in lines),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
    }


def brute(text, rules=RULES):
    m = brute_measures(text)
    base = [
        name
        for name, bad in (("too_short", m["n_words"] < 20), ("repeats_itself", 10 * m["n_repeat_words"] > 3 * m["n_words"]))
        if bad
    ]
    broken = []
    for rule in rules:
        per = 1 if rule.per is None else m[rule.per]
        low = rule.at_least is None or m[rule.measure] >= rule.at_least * per
        high = rule.at_most is None or m[rule.measure] <= rule.at_most * per
        broken += [] if low and high else [rule.name]
    return m, bool(base), base + broken, not base and not broken


TEXTS = [
    "- the one\n* to two\n • und drei\nfour...\nfive …\n" + prose(1, 30),
    "the " + prose(2, 40) + "\n" + "same line the\n" * 6,
    "a b c d e f g h " * 2 + prose(3, 60) + " the of",
    "a " * 8, "a " * 9, "a b " * 6, "### $$$ %%% " * 20, "é ß x the " * 30,
    "\n\n\n", "x\r\ny\r\nx\r\n", "the " + prose(5, 19), "the " + prose(5, 18),
    prose(6, 10) + " the " + prose(6, 10) + " of " + prose(7, 30),
]


def check(docs, got):
    expected = [(r["doc_id"], *brute(r["text"])) for r in docs.collect()]
    seen = [
        (r["doc_id"], {n: r[n] for n in brute_measures("")}, r["base_failed"], r["failed"], r["kept"])
        for r in got.collect()
    ]
    assert sorted(map(str, seen)) == sorted(map(str, expected))


def test_rows_of_every_kind(spark, edge):
    check(edge, judge_quality(edge))
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    judged = judge_quality(docs)
    check(docs, judged)
    assert {r["kept"] for r in judged.collect()} == {True, False}


def test_window_shared_by_chance_of_position_only(spark):
    # Overlapping repeats, repeats at the very end, and a run of one word.
    w = [f"w{i}" for i in range(12)]
    texts = [" ".join(w[:9] * 2), " ".join(w + ["z"] + w[:8]), " ".join(["q"] * 50), " ".join(w * 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(docs, judge_quality(docs))


def test_no_python_in_the_plan(edge):
    plan = judge_quality(edge)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


def test_own_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x", "y")], "n_words long, body string, kept long, _m string, failed string")
    rules = [Rule("two", "n_words", at_least=2, at_most=2), Rule("none", "n_symbols", at_most=0)]
    got = judge_quality(docs.withColumnRenamed("n_words", "id"), rules=rules, base=[], key="id", text="body").first()
    assert (got["id"], got["failed"], got["base_failed"], got["kept"]) == (1, [], False, True)
    none = judge_quality(docs.withColumnRenamed("n_words", "id"), rules=[], base=[], key="id", text="body").first()
    assert none["kept"] is True


@pytest.mark.parametrize("rule", RULES)
def test_every_rule_has_a_bound(rule):
    assert rule.at_least is not None or rule.at_most is not None


def test_empty_table(nothing):
    assert judge_quality(nothing).count() == 0
