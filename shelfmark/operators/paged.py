"""Documents that come as pages: one row per (document, page number)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..fixed_values import FLAG_PAGES, PAGE_PREVIEW_CHARS, TEXT_PAGES
from ..functions import text as tf

PAGE_BREAK = "\n\n"


def page_count(pages: DataFrame, doc: str) -> DataFrame:
    """Pages per document."""
    return pages.groupBy(doc).agg(F.count("*").alias("page_count"))


def _first_pages(pages: DataFrame, doc: str, page_no: str, n: int) -> DataFrame:
    """The first ``n`` pages of each document; the cut is made before the shuffle."""
    order = Window.partitionBy(doc).orderBy(page_no)
    return pages.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= n)


def join_first_pages(
    pages: DataFrame, doc: str, page_no: str, text: str = "text", n: int = TEXT_PAGES
) -> DataFrame:
    """``doc, text``: the first ``n`` page texts in order, each followed by a blank line."""
    first = _first_pages(pages, doc, page_no, n)
    ordered = F.array_sort(F.collect_list(F.struct("__rank", F.col(text).alias("page"))))
    # A page without text adds nothing, not even its blank line.
    texts = F.transform(
        F.filter(ordered, lambda p: p["page"].isNotNull()),
        lambda p: F.concat(p["page"], F.lit(PAGE_BREAK)),
    )
    return first.groupBy(doc).agg(F.array_join(texts, "").alias("text"))


def page_text_stats(
    pages: DataFrame, doc: str, page_no: str, text: str = "text", n: int | None = None
) -> DataFrame:
    """Preview (cut at 10,000 characters, then ``...``), words and characters of all pages,
    or of the first ``n``; each page with text counts with the blank line behind it.

    Words and characters are summed from the pages, and only the pages that the preview
    needs are joined. A document without text has an empty preview and no words.
    """
    if n is not None:
        pages = _first_pages(pages, doc, page_no, n).drop("__rank")
    size = F.coalesce(F.length(text) + len(PAGE_BREAK), F.lit(0))
    before = Window.partitionBy(doc).orderBy(page_no).rowsBetween(Window.unboundedPreceding, -1)
    shown = (
        pages.select(doc, page_no, F.col(text).alias("__text"), size.alias("__size"))
        .withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0)))
        .where(F.col("__before") <= PAGE_PREVIEW_CHARS)
    )
    ordered = F.array_sort(
        F.collect_list(F.when(F.col("__text").isNotNull(), F.struct("__before", page_no, "__text")))
    )
    start = shown.groupBy(doc).agg(
        F.array_join(F.transform(ordered, lambda p: F.concat(p["__text"], F.lit(PAGE_BREAK))), "").alias("__start")
    )
    totals = pages.groupBy(doc).agg(
        F.coalesce(F.sum(tf.word_count(F.col(text))), F.lit(0)).alias("word_count"),
        F.sum(size).alias("char_count"),
    )
    preview = F.when(
        F.col("char_count") > PAGE_PREVIEW_CHARS,
        F.concat(F.substring("__start", 1, PAGE_PREVIEW_CHARS), F.lit("...")),
    ).otherwise(F.col("__start"))
    named = start.withColumnRenamed(doc, "__doc")
    return totals.join(named, F.col(doc).eqNullSafe(F.col("__doc"))).select(
        doc, preview.alias("text_preview"), "word_count", "char_count"
    )


def any_in_first_pages(
    pages: DataFrame, doc: str, page_no: str, flag: str, n: int = FLAG_PAGES
) -> DataFrame:
    """Does any of the first ``n`` pages of a document satisfy the flag?"""
    first = _first_pages(pages, doc, page_no, n)
    return first.groupBy(doc).agg(F.coalesce(F.bool_or(flag), F.lit(False)).alias("any_page"))
