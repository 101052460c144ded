"""The text profile of a content column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import KEYWORDS_PER_FILE, LANGUAGE_WORDS, PREVIEW_CHARS
from ..functions import text as tf
from ..session import wide

ROWS_OF_A_KEY = 64  # rows of one key whose texts may meet in one task


def text_fields(content: Column, lowered: Column, k: int = KEYWORDS_PER_FILE) -> dict[str, Column]:
    """The text fields from the content and its lower-case words; null for null content."""
    return {
        "content_preview": tf.content_preview(content, PREVIEW_CHARS),
        "line_count": tf.line_count(content),
        "word_count": tf.word_count(content, lowered),
        "char_count": tf.char_count(content),
        "language": F.when(content.isNotNull(), tf.detect_language(lowered)),
        "keywords": F.when(content.isNotNull(), tf.keywords(lowered, k)),
    }


def text_profile(
    df: DataFrame,
    content: str = "content",
    max_chars: int | None = None,
    k: int = KEYWORDS_PER_FILE,
) -> DataFrame:
    """Add preview, line, word and character counts, language and keywords.

    Every field is a column of its own over a shared word list, so a query that uses
    only some of them computes only those.
    """
    text = F.col(content) if max_chars is None else F.substring(content, 1, max_chars)
    worded = df.withColumn("__words", tf.lower_words(text))
    return worded.withColumns(text_fields(text, F.col("__words"), k)).drop("__words")


def extract_keywords(
    df: DataFrame, key: str, content: str = "content", k: int = KEYWORDS_PER_FILE
) -> DataFrame:
    """Long form: one row per document and keyword with its rank (from 1).

    Words are counted as rows, line by line, and combined before any shuffle of them, so no task
    holds the words of a whole document. Rows of one key count as one document. Where keys
    hardly repeat, texts meet by key; else counted words do, so that no task has all rows
    of a key.
    """
    texts = df.select(key, content)
    most = texts.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    if most <= ROWS_OF_A_KEY:
        # The texts are smaller than their counted words, and nothing else is shuffled then.
        texts = texts.repartition(wide(df.sparkSession), key)
    lines = texts.select(
        F.col(key), F.posexplode(F.split(F.lower(F.col(content)), "\n", -1)).alias("line", "__text")
    )
    found = lines.select(
        key, "line", F.posexplode(tf.words(F.col("__text"))).alias("place", "keyword")
    ).where(tf.may_be_keyword(F.col("keyword")))
    return _ranked(found, key, "line", k)


def _ranked(found: DataFrame, key: str, part: str, k: int) -> DataFrame:
    """The ``k`` most frequent words of a key with their ranks, from its words by part and place."""
    # Part and place as one number: a minimum of structs would sort, and spill, all words.
    first = F.shiftleft(F.col(part).cast("long"), 32) + F.col("place")
    counted = found.groupBy(key, "keyword").agg(F.count("*").alias("n"), F.min(first).alias("first"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), "first")
    ranked = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(key, "rank", "keyword")


def profile_pieces(pieces: DataFrame, key: str = "path", k: int = KEYWORDS_PER_FILE) -> DataFrame:
    """The text fields of texts that come in pieces, and ``read_error``: one row per key.

    ``pieces`` has the key, ``piece`` (from 0, in order), ``content`` and ``read_error``. No line
    end or word goes on from one piece to the next, and piece 0 holds the preview (see
    ``text_pieces``). A piece is reduced to a few numbers in its own row; its words are counted
    in the task before they are shuffled. A text with a piece that could not be read has no fields.
    """
    content, words, hits = F.col("content"), F.col("__words"), F.col("__hits")
    preview = tf.content_preview(content, PREVIEW_CHARS)
    worded = pieces.withColumn("__words", tf.lower_words(content))
    sums = worded.withColumn("__hits", tf.language_hits(words)).groupBy(key).agg(
        # Lists: a maximum of strings would sort the rows with their contents.
        F.get(F.collect_list(F.when(F.col("piece") == 0, preview)), F.lit(0)).alias("content_preview"),
        (F.sum(tf.line_count(content) - 1) + 1).alias("line_count"),
        F.sum(tf.word_count(content, words)).alias("word_count"),
        F.sum(tf.char_count(content)).alias("char_count"),
        *[F.sum(hits.getField(c)).alias(f"__{c}") for c in LANGUAGE_WORDS],
        F.array_min(F.collect_set("read_error")).alias("read_error"),
    )
    # Outer: the plain generator lets Spark derive a filter that cuts the text into words once more.
    found = worded.select(key, "piece", F.posexplode_outer("__words").alias("place", "keyword"))
    ranked = _ranked(found.where(tf.may_be_keyword(F.col("keyword"))), key, "piece", k)
    top = F.array_sort(F.collect_list(F.struct("rank", "keyword")))
    listed = ranked.groupBy(key).agg(F.transform(top, lambda t: t["keyword"]).alias("keywords"))
    language = tf.choose_language(F.struct(*[F.col(f"__{c}").alias(c) for c in LANGUAGE_WORDS]))
    fields = {n: F.col(n) for n in ("content_preview", "line_count", "word_count", "char_count")} | {
        "language": language, "keywords": F.coalesce("keywords", F.array().cast("array<string>")),
    }
    was_read = F.col("read_error").isNull()
    return sums.join(listed, key, "left").select(
        key, *[F.when(was_read, c).alias(n) for n, c in fields.items()], "read_error"
    )


def language_breakdown(df: DataFrame, language: str = "language") -> DataFrame:
    """Documents per detected language."""
    return df.groupBy(F.col(language).alias("language")).agg(F.count("*").alias("n"))
