"""Sample rows that the tests of all operators share."""

import random

# Rows that every operator on documents must handle: nulls in any column, empty and very
# long texts, repeated rows, equal texts, and columns whose names clash with results.
WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ru") for b in ("sel", "tor", "van", "x") for c in ("e", "an", "o")]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, _row string"


def edge_rows() -> list[tuple]:
    rows = [(i, prose(i, 60), "en" if i % 2 else "fr", f"s{i % 3}") for i in range(12)]
    rows += [
        (20, None, "en", "s0"),
        (21, "", "en", "s1"),
        (22, " \t\n ", None, "s2"),
        (23, "one", "en", None),
        (24, prose(3, 60), None, "s0"),
        (24, prose(3, 60), None, "s0"),
        (None, prose(4, 50), "en", "s1"),
        (None, None, None, None),
        (25, prose(9, 30_000), "fr", "s2"),
        (26, "ÀÉ ß " + prose(5, 60) + "\n" + prose(5, 60), "fr", "s0"),
        (27, "same " * 300, "en", "s1"),
        (28, "!!! 123 ...", "en", "s1"),
    ]
    return [(*r, len(r[1]) if r[1] is not None else None, 0.5, 7, "x") for r in rows]
