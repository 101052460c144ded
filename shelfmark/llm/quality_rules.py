"""Quality rules: a threshold table compiled into one projection of text measures and ratios."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

# Very common words of the languages the rules are meant for; a word counts as it stands or
# with a capital first letter.
STOP_WORDS = (
    "the be to of and that have with is in for "
    "der die das und ist zu ein nicht von den "
    "le la les de des et un une en que est pour "
    "el los las y por del con una es "
    "il che di per non sono "
    "o os da do em um uma para "
    "het een van op"
).split()


@dataclass(frozen=True)
class Rule:
    """``at_least * per <= measure <= at_most * per``; without ``per`` the measure itself."""

    name: str
    measure: str
    per: str | None = None
    at_least: float | None = None
    at_most: float | None = None

    def holds(self, measures: Column) -> Column:
        value = measures.getField(self.measure)
        base = F.lit(1.0) if self.per is None else measures.getField(self.per)
        tests = []
        if self.at_least is not None:
            tests.append(value >= F.lit(float(self.at_least)) * base)
        if self.at_most is not None:
            tests.append(value <= F.lit(float(self.at_most)) * base)
        return reduce(lambda a, b: a & b, tests, F.lit(True))


# Texts that fail one of these are dropped whatever the table below says.
BASE_RULES = [
    Rule("too_short", "n_words", at_least=20),
    Rule("repeats_itself", "n_repeat_words", "n_words", at_most=0.3),
]

RULES = [
    Rule("short_words", "word_chars", "n_words", at_least=2.0),
    Rule("long_words", "word_chars", "n_words", at_most=15.0),
    Rule("symbols", "n_symbols", "n_words", at_most=0.1),
    Rule("stop_words", "n_stop_words", "n_words", at_least=0.02),
    Rule("repeated_lines", "n_dup_lines", "n_lines", at_most=0.3),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", at_most=0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", at_most=0.3),
]


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _repeat_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window whose words occur twice or more.

    Windows are compared by the 64-bit hash of their words' hashes. Only a text in which some
    hash repeats has its windows ordered; then the covered words are the union of the
    stretches that start at the repeated windows.
    """

    def covered(places: Column) -> Column:
        steps = F.transform(
            places,
            lambda p, i: F.least(F.lit(window), F.coalesce(F.get(places, i + 1) - p, F.lit(window))),
        )
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, s: a + s)

    def repeated(windows: Column) -> Column:
        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
        return let(
            ordered,
            lambda o: let(
                F.array_sort(
                    F.transform(
                        F.filter(
                            F.transform(
                                o,
                                lambda w, i: F.struct(
                                    w.getField("at").alias("at"),
                                    (
                                        F.coalesce(F.get(o, i - 1).getField("h") == w.getField("h"), F.lit(False))
                                        | F.coalesce(F.get(o, i + 1).getField("h") == w.getField("h"), F.lit(False))
                                    ).alias("twice"),
                                ),
                            ),
                            lambda w: w.getField("twice"),
                        ),
                        lambda w: w.getField("at"),
                    )
                ),
                covered,
            ),
        )

    def measure(hashes: Column) -> Column:
        heads = F.slice(hashes, F.lit(1), F.size(hashes) - (window - 1))
        windows = F.transform(
            heads, lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, window)])
        )
        return let(
            windows,
            lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(repeated(w)),
        )

    return F.when(F.size(words) < window + 1, F.lit(0).cast("long")).otherwise(
        let(F.transform(words, lambda w: F.xxhash64(w)), measure)
    )


def text_measures(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """One struct of counts over a whole text; a null text counts as empty.

    Words are runs of anything but space and 0x09-0x0D, lines are split at ``\\n`` and count
    where they hold a word; a line that equals an earlier one is a repeat.
    """
    whole = F.coalesce(text, F.lit(""))
    known = [*stop_words, *(w[:1].upper() + w[1:] for w in stop_words)]

    def many(array: Column, test) -> Column:
        return F.size(F.filter(array, test)).cast("long")

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            many(words, lambda w: w.isin(known)).alias("n_stop_words"),
            _repeat_words(words).alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            many(lines, lambda s: F.ltrim(s).substr(1, 1).isin("-", "*", "•")).alias("n_bullet_lines"),
            many(lines, lambda s: F.rtrim(s).endswith("...") | F.rtrim(s).endswith("…")).alias("n_ellipsis_lines"),
        )

    lines = F.filter(F.split(whole, "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    return let(
        F.struct(
            let(F.regexp_extract_all(whole, F.lit(WORD), 0), of_words).alias("w"),
            let(lines, of_lines).alias("l"),
        ),
        lambda m: F.struct(
            *[m.getField("w").getField(n).alias(n) for n in ("n_words", "n_stop_words", "n_repeat_words")],
            *[m.getField("l").getField(n).alias(n) for n in ("n_lines", "n_dup_lines", "n_bullet_lines",
                                                             "n_ellipsis_lines")],
            F.length(_without(whole, BLANKS)).cast("long").alias("word_chars"),
            (F.length(whole) - F.length(_without(whole, SYMBOLS))).cast("long").alias("n_symbols"),
        ),
    )


def failed_rules(measures: Column, rules: Sequence[Rule]) -> Column:
    """The names of the rules that the measures break, in the table's order."""
    named = [F.when(~rule.holds(measures), F.lit(rule.name)) for rule in rules]
    return F.array_compact(F.array(*named)) if named else F.array().cast("array<string>")


def judge_quality(
    docs: DataFrame,
    *,
    rules: Sequence[Rule] = tuple(RULES),
    base: Sequence[Rule] = tuple(BASE_RULES),
    stop_words: Sequence[str] = STOP_WORDS,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Measures and verdict of every whole text, one row per row of ``docs``.

    Columns: key, the measures of ``text_measures``, base_failed, failed (names of broken
    rules of both tables) and kept. Everything is one projection in the scan stage: no
    shuffle, no Python worker, no state beyond the row. A null, empty or blank text has all
    measures 0 and fails as too short. Repeated rows are judged each on their own; other
    columns, whatever their names, are neither read nor returned. An empty table gives none.
    """
    measured = docs.select(F.col(key), text_measures(F.col(text), stop_words).alias("_m"))
    verdict = F.struct(
        failed_rules(F.col("_m"), base).alias("base"), failed_rules(F.col("_m"), rules).alias("table")
    )
    judged = measured.select(F.col(key), F.col("_m"), let(verdict, lambda v: v).alias("_v"))
    return judged.select(
        F.col(key),
        "_m.*",
        (F.size("_v.base") > 0).alias("base_failed"),
        F.concat("_v.base", "_v.table").alias("failed"),
        ((F.size("_v.base") == 0) & (F.size("_v.table") == 0)).alias("kept"),
    )
