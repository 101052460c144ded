"""Text columns: counts, language and keywords, all computed within the row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import (
    KEYWORDS_PER_FILE,
    LANGUAGE_WORDS,
    MIN_KEYWORD_LENGTH,
    PREVIEW_CHARS,
    STOP_WORDS,
    UNKNOWN_LANGUAGE,
    WORD_PATTERN,
)
from .binding import let


def decode_text(content: Column, max_chars: int | None = None) -> Column:
    """UTF-8 with replacement characters and ``\\n`` line ends; the whole text by default."""
    text = F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n?", "\n")
    return text if max_chars is None else F.substring(text, 1, max_chars)


def content_preview(content: Column, chars: int = PREVIEW_CHARS) -> Column:
    return F.substring(content, 1, chars)


def line_count(content: Column) -> Column:
    """Newlines plus one."""
    breaks = F.length(content) - F.length(F.replace(content, F.lit("\n")))
    return (breaks + 1).cast("long")


def char_count(content: Column) -> Column:
    return F.length(content).cast("long")


def words(content: Column) -> Column:
    """Every run of word characters, in order."""
    return F.regexp_extract_all(content, F.lit(WORD_PATTERN), 0)


def lower_words(content: Column) -> Column:
    return words(F.lower(content))


def word_count(content: Column, lowered: Column | None = None) -> Column:
    """Number of words; reuses the lower-case word list where there is one.

    Lowering changes the number of words only for the dotted capital I, whose lower
    case holds a combining mark.
    """
    if lowered is None:
        return F.size(words(content)).cast("long")
    split_by_case = F.contains(content, F.lit("İ"))
    return F.when(split_by_case, F.size(words(content))).otherwise(F.size(lowered)).cast("long")


def language_hits(lowered: Column) -> Column:
    """A struct of the common words found, per language."""
    listed = sorted({word for known in LANGUAGE_WORDS.values() for word in known})

    def count_of(hits: Column, known: list[str]) -> Column:
        return F.size(F.filter(hits, lambda w: w.isin(known)))

    # One set lookup per word leaves the few listed words; those are counted per language.
    return let(
        F.filter(lowered, lambda w: w.isin(listed)),
        lambda hits: F.struct(*[count_of(hits, known).alias(c) for c, known in LANGUAGE_WORDS.items()]),
    )


def choose_language(hits: Column) -> Column:
    """The language with strictly the most hits, else ``unknown``."""
    chosen = F.lit(UNKNOWN_LANGUAGE)
    for code in LANGUAGE_WORDS:
        others = [hits.getField(o) for o in LANGUAGE_WORDS if o != code]
        wins = reduce(lambda a, b: a & b, [hits.getField(code) > o for o in others])
        chosen = F.when(wins, F.lit(code)).otherwise(chosen)
    return chosen


def detect_language(lowered: Column) -> Column:
    """The language with strictly the most common-word hits, else ``unknown``."""
    return let(language_hits(lowered), choose_language)


def may_be_keyword(word: Column) -> Column:
    """Long enough and not a common word."""
    return (F.length(word) >= MIN_KEYWORD_LENGTH) & ~word.isin(STOP_WORDS)


def keywords(lowered: Column, k: int = KEYWORDS_PER_FILE) -> Column:
    """The ``k`` most frequent words, ties by first position, as an array.

    Everything happens inside the row, so no shuffle is needed: the words are sorted and
    runs of the same word measured. Only words at least as frequent as the ``k``-th are
    ordered by position, which ``array_intersect`` gives: it keeps the order of its
    first argument.
    """
    eligible = F.filter(lowered, may_be_keyword)

    def top(words_: Column, s: Column, runs: Column, kth: Column) -> Column:
        def words_of(chosen: Column) -> Column:
            return F.transform(chosen, lambda r: F.get(s, r.getField("at")))

        def order(above: Column) -> Column:
            placed = F.array_intersect(words_, words_of(above))
            ranked = F.sort_array(
                F.transform(
                    above,
                    lambda r: F.struct(
                        (-r.getField("n")).alias("minus_n"),
                        F.array_position(placed, F.get(s, r.getField("at"))).alias("first"),
                        F.get(s, r.getField("at")).alias("word"),
                    ),
                )
            )
            tied = words_of(F.filter(runs, lambda r: r.getField("n") == kth))
            return F.concat(
                F.transform(ranked, lambda r: r.getField("word")),
                F.slice(F.array_intersect(words_, tied), F.lit(1), F.lit(k) - F.size(above)),
            )

        return let(F.filter(runs, lambda r: r.getField("n") > kth), order)

    def measure(words_: Column, s: Column, starts: Column) -> Column:
        runs = F.transform(
            starts,
            lambda at, j: F.struct(
                at.alias("at"), (F.coalesce(F.get(starts, j + 1), F.size(s)) - at).alias("n")
            ),
        )
        return let(
            runs,
            lambda r: let(
                F.coalesce(
                    F.get(F.sort_array(r.getField("n"), asc=False), F.lit(k - 1)), F.lit(1)
                ),
                lambda kth: top(words_, s, r, kth),
            ),
        )

    def starts_of(s: Column) -> Column:
        return F.filter(
            F.transform(s, lambda _, i: i),
            lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)),
        )

    return let(
        eligible,
        lambda e: let(F.sort_array(e), lambda s: let(starts_of(s), lambda b: measure(e, s, b))),
    )
