"""Child tables of files (pages, pixels, arrays) rolled up to one struct per file.

A file may hold many pages, millions of pixels or many arrays. They live in tables of their
own with the file's path; each is reduced to one row per path, and the record of a file takes
the structs of all its children in joins that share one partitioning by path.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import DOMINANT_VALUES
from ..functions import images
from .distributions import average_color, dominant_values
from .paged import page_count, page_text_stats

# What a container file may hold, as one JSON object; any part may be missing.
CONTAINER = (
    "pages array<string>, width int, height int, pixels array<array<int>>, arrays map<string,array<double>>"
)


def read_containers(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """``path`` and the parts of container files; a text that is none has no parts."""
    return files.select(F.col(path).alias("path"), F.from_json(F.col(content), CONTAINER).alias("__parts")).select(
        "path", "__parts.*"
    )


def container_tables(containers: DataFrame) -> dict[str, DataFrame]:
    """The child tables ``pages``, ``pixels`` and ``arrays`` of ``read_containers``."""
    pixel = F.col("pixel")
    return {
        "pages": containers.select("path", F.posexplode("pages").alias("page_no", "text")),
        "pixels": containers.select("path", "width", "height", F.explode("pixels").alias("pixel")).select(
            "path", "width", "height", *[F.get(pixel, F.lit(i)).alias(c) for i, c in enumerate("rgb")]
        ),
        "arrays": containers.select("path", F.explode("arrays").alias("name", "values")),
    }


def page_profile(pages: DataFrame, name: str = "pages") -> DataFrame:
    """``path`` and a struct: page_count, text_preview, word_count, char_count.

    ``pages`` has path, page_no and text. Pages without a path belong to no file.
    """
    owned = pages.where(F.col("path").isNotNull())
    stats = page_text_stats(owned, "path", "page_no")
    return page_count(owned, "path").join(stats, "path").select(
        "path", F.struct("page_count", "text_preview", "word_count", "char_count").alias(name)
    )


def colour_profile(pixels: DataFrame, name: str = "image", k: int = DOMINANT_VALUES) -> DataFrame:
    """``path`` and a struct: width, height, aspect_ratio, pixel_count, hex, brightness and the
    ``k`` dominant colours (hex, percentage), most frequent first.

    ``pixels`` has path, width, height, r, g and b. A pixel that lacks a channel is no
    colour; pixels are counted on the map side, so an image of any size is spread over tasks.
    """
    whole = pixels.where(
        F.col("path").isNotNull() & F.col("r").isNotNull() & F.col("g").isNotNull() & F.col("b").isNotNull()
    )
    top = dominant_values(whole, "path", ["r", "g", "b"], k).groupBy("path").agg(
        F.array_sort(
            F.collect_list(F.struct("rank", images.hex_color(F.col("r"), F.col("g"), F.col("b")).alias("hex"), "percentage"))
        ).alias("__top")
    )
    size = whole.groupBy("path").agg(F.max("width").alias("width"), F.max("height").alias("height"))
    width, height = F.col("width"), F.col("height")
    return average_color(whole, "path").join(size, "path").join(top, "path").select(
        "path",
        F.struct(
            width, height,
            images.aspect_ratio(width, height).alias("aspect_ratio"),
            images.pixel_count(width, height).alias("pixel_count"),
            "hex", "brightness",
            F.transform("__top", lambda t: F.struct(t["hex"].alias("hex"), t["percentage"].alias("percentage"))).alias(
                "dominant"
            ),
        ).alias(name),
    )


def array_profile(datasets: DataFrame, name: str = "arrays") -> DataFrame:
    """``path`` and a struct: total_datasets, total_elements, total_size_bytes, min, max, mean.

    ``datasets`` has path, name and values (doubles). Elements that are null or not a number
    have a size but no part in the statistics. Every array is reduced in its own row, so
    only a few numbers per array are shuffled.
    """
    values = F.filter("values", lambda v: v.isNotNull() & ~F.isnan(v))
    rows = datasets.where(F.col("path").isNotNull() & F.col("values").isNotNull()).select(
        "path",
        F.size("values").cast("long").alias("n"),
        F.size(values).cast("long").alias("known"),
        F.array_min(values).alias("low"),
        F.array_max(values).alias("high"),
        F.aggregate(values, F.lit(0.0), lambda a, v: a + v).alias("total"),
    )
    return rows.groupBy("path").agg(
        F.struct(
            F.count(F.lit(1)).alias("total_datasets"),
            F.sum("n").alias("total_elements"),
            (F.sum("n") * 8).alias("total_size_bytes"),
            F.min("low").alias("min"),
            F.max("high").alias("max"),
            F.try_divide(F.sum("total"), F.sum("known")).alias("mean"),
        ).alias(name)
    )


def container_profiles(containers: DataFrame) -> dict[str, DataFrame]:
    """The profiles of all child tables of ``read_containers``, by the name they have in a record."""
    tables = container_tables(containers)
    return {
        "pages": page_profile(tables["pages"]),
        "image": colour_profile(tables["pixels"]),
        "arrays": array_profile(tables["arrays"]),
    }


def merge_children(record: DataFrame, profiles: Mapping[str, DataFrame], path: str = "path") -> DataFrame:
    """Add the struct of each child profile to the record of its path; null where it has none.

    A profile has one row per path: path and a struct column of its name. All of them come
    out of aggregations by path, so the record is shuffled once (or not, where profiles are
    small enough for Spark to broadcast) and no profile again. A record without a path has
    no children; repeated paths all get them.
    """
    for name, profile in profiles.items():
        if name in record.columns:
            raise ValueError(f"the record has a column {name!r} already")
        record = record.join(profile.select(F.col("path").alias(path), name), path, "left")
    return record
