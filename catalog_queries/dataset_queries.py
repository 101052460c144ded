"""Arrays, hierarchies, value distributions, paged documents and source code."""

from __future__ import annotations

import uuid

import shelfmark as sm
from pyspark.sql import functions as F
from shelfmark.functions import images
from shelfmark.functions.arrays import limit_attributes as first_attributes
from shelfmark.functions.values import parse_compact_date as compact_date
from shelfmark.session import wide, work_dir

from .selection_queries import LINES
from .views import table, view, with_views

QUERIES, ORACLES = {}, {}

# ---- arrays and hierarchies ----------------------------------------------------------


def array_statistics(spark, sf_dir):
    """Each vector twenty times over: arrays of more than a thousand elements."""
    long = F.flatten(F.array_repeat("embedding", 20))
    stats = sm.array_statistics(table(spark, sf_dir, "embeddings").withColumn("embedding", long), "embedding")
    return stats.select("vec_id", *[F.round(n, 6).alias(n) for n in ("min", "max", "mean", "std")])


QUERIES["array_statistics"] = array_statistics
ORACLES["array_statistics"] = """SELECT vec_id, round(min(x), 6) AS "min", round(max(x), 6) AS "max",
  round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std
FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY vec_id"""

QUERIES["array_layout"] = lambda spark, sf_dir: sm.array_layout(
    table(spark, sf_dir, "embeddings"), "embedding"
).select("vec_id", "n_elements", "shape", "dtype", "size_bytes")
ORACLES["array_layout"] = """SELECT vec_id, len(embedding) AS n_elements,
  '(' || len(embedding) || ',)' AS shape, 'float' AS dtype, len(embedding) * 4 AS size_bytes
FROM embeddings"""

QUERIES["dataset_totals"] = lambda spark, sf_dir: sm.dataset_totals(
    sm.array_layout(table(spark, sf_dir, "embeddings"), "embedding"), "label"
)
ORACLES["dataset_totals"] = """SELECT label, count(*) AS total_datasets,
  CAST(sum(len(embedding) * 4) AS BIGINT) AS total_size_bytes FROM embeddings GROUP BY label"""

QUERIES["list_hierarchy"] = lambda spark, sf_dir: sm.list_hierarchy(
    view(spark, sf_dir, "files")
)
ORACLES["list_hierarchy"] = with_views(
    """, parts AS (
  SELECT substr(path, 2) AS item, string_split(substr(path, 2), '/') AS p FROM files),
nodes AS (
  SELECT DISTINCT array_to_string(p[1:i], '/') AS item, array_to_string(p[1:i-1], '/') AS parent,
         i - 1 AS depth, i = len(p) AS leaf
  FROM (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM parts)),
children AS (SELECT parent, count(*) AS num_items FROM nodes GROUP BY parent),
ranked AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY item) AS rn FROM nodes WHERE leaf)
SELECT item, parent, 'group' AS type, CAST(depth AS BIGINT) AS depth, num_items
FROM nodes JOIN children c ON c.parent = nodes.item WHERE NOT leaf
UNION ALL
SELECT item, parent, 'dataset', CAST(depth AS BIGINT), NULL FROM ranked""".replace(
        "JOIN children c ON c.parent = nodes.item",
        "JOIN (SELECT parent AS of_item, num_items FROM children) c ON c.of_item = nodes.item",
    ),
    "files",
)


def limit_attributes(spark, sf_dir):
    names = ["p_name", "p_brand", "p_type", "p_size"]
    attributes = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))])
    kept = table(spark, sf_dir, "part").select("p_partkey", first_attributes(attributes, 3).alias("kept"))
    pairs = F.transform(F.map_entries("kept"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return kept.select("p_partkey", F.array_join(pairs, ";").alias("attributes"))


QUERIES["limit_attributes"] = limit_attributes
ORACLES["limit_attributes"] = """SELECT p_partkey,
  'p_name=' || p_name || ';p_brand=' || p_brand || ';p_type=' || p_type AS attributes FROM part"""

# ---- value distributions -----------------------------------------------------------------

QUERIES["dominant_values"] = lambda spark, sf_dir: sm.dominant_values(
    view(spark, sf_dir, "pixels"), "image_id", ["r", "g", "b"]
)
ORACLES["dominant_values"] = with_views(
    """SELECT image_id, r, g, b, n, round_even(n / total * 100, 2) AS percentage, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, r, g, b) AS rank,
             sum(n) OVER (PARTITION BY image_id) AS total
      FROM (SELECT image_id, r, g, b, count(*) AS n FROM pixels GROUP BY ALL))
WHERE rank <= 5""",
    "pixels",
)

QUERIES["hex_color"] = lambda spark, sf_dir: view(spark, sf_dir, "pixels").groupBy(
    images.hex_color(F.col("r"), F.col("g"), F.col("b")).alias("hex")
).agg(F.count("*").alias("n"))
ORACLES["hex_color"] = with_views(
    "SELECT printf('#%02x%02x%02x', r, g, b) AS hex, count(*) AS n FROM pixels GROUP BY 1", "pixels"
)

QUERIES["average_color"] = lambda spark, sf_dir: sm.average_color(
    view(spark, sf_dir, "pixels"), "image_id"
).drop("brightness")
ORACLES["average_color"] = with_views(
    """SELECT image_id, r, g, b, printf('#%02x%02x%02x', r, g, b) AS hex
FROM (SELECT image_id, CAST(round_even(avg(r), 0) AS INTEGER) AS r,
        CAST(round_even(avg(g), 0) AS INTEGER) AS g, CAST(round_even(avg(b), 0) AS INTEGER) AS b
      FROM pixels GROUP BY image_id)""",
    "pixels",
)

QUERIES["brightness"] = lambda spark, sf_dir: view(spark, sf_dir, "pixels").groupBy(
    images.brightness(F.col("r"), F.col("g"), F.col("b")).alias("brightness")
).agg(F.count("*").alias("n"))
ORACLES["brightness"] = with_views(
    """SELECT round_even((0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b) / 255, 2) AS brightness,
  count(*) AS n FROM pixels GROUP BY 1""",
    "pixels",
)

QUERIES["image_geometry"] = lambda spark, sf_dir: sm.image_geometry(
    table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        (F.col("l_quantity") * 16).cast("int").alias("width"),
        (F.col("l_linenumber") - 1).alias("height"),
    )
)
ORACLES["image_geometry"] = """SELECT l_orderkey, l_linenumber, width, height,
  CASE WHEN height > 0 THEN round_even(width / height, 3) END AS aspect_ratio,
  CAST(width AS BIGINT) * height AS pixel_count
FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity * 16 AS INTEGER) AS width,
             l_linenumber - 1 AS height FROM lineitem)"""


def gps_decimal(spark, sf_dir):
    return view(spark, sf_dir, "camera").select(
        "p_partkey",
        images.gps_decimal(F.col("deg"), F.col("mins"), F.col("secs"), F.col("hemisphere")).alias("position"),
        images.gps_altitude(F.col("p_partkey"), F.lit(4), F.col("altitude_ref")).alias("altitude"),
    )


QUERIES["gps_decimal"] = gps_decimal
ORACLES["gps_decimal"] = with_views(
    """SELECT p_partkey,
  round_even((deg + mins / 60 + secs / 3600) * CASE WHEN hemisphere IN ('S', 'W') THEN -1 ELSE 1 END, 6) AS position,
  p_partkey / 4 * CASE WHEN altitude_ref = 1 THEN -1 ELSE 1 END AS altitude
FROM camera""",
    "camera",
)


def exif_common(spark, sf_dir):
    tags = {
        "Make": "make", "Model": "model", "ExposureTime": "exposure", "FNumber": "f_number",
        "ISOSpeedRatings": "iso", "FocalLength": "focal", "DateTimeOriginal": "taken",
        "GPSLatitude": "latitude", "GPSLatitudeRef": "north", "GPSLongitude": "longitude",
        "GPSLongitudeRef": "east", "GPSAltitude": "height", "GPSAltitudeRef": "altitude_ref",
    }
    place = F.concat(F.lit("["), F.col("deg").cast("int"), F.lit(", "), F.col("mins").cast("int"), F.lit("/1, "),
                     F.col("secs").cast("int"), F.lit("/1]"))
    shot = view(spark, sf_dir, "camera").withColumns({
        "taken": F.concat(F.lit("2020:01:02 03:04:"), F.lpad(F.col("secs").cast("int").cast("string"), 2, "0")),
        "latitude": place, "longitude": place, "height": F.concat(F.col("p_partkey").cast("string"), F.lit("/4")),
        "north": F.when(F.col("hemisphere") == "S", "S").otherwise("N"),
        "east": F.when(F.col("hemisphere") == "W", "W").otherwise("E"),
        "altitude_ref": F.col("altitude_ref").cast("string"),
    })
    tag_map = F.create_map(*[x for tag, c in tags.items() for x in (F.lit(tag), F.col(c))])
    common = shot.select("p_partkey", images.exif_common(tag_map).alias("c"))
    return common.select("p_partkey", "c.*", "c.gps.*").drop("gps").withColumns({
        "exposure_time": F.round(F.col("exposure_time").cast("double"), 9),
        "latitude": F.round("latitude", 4), "longitude": F.round("longitude", 4),
    })


QUERIES["exif_common"] = exif_common
ORACLES["exif_common"] = with_views(
    """SELECT p_partkey, make AS camera_make, model AS camera_model, 
  '2020:01:02 03:04:' || lpad(CAST(CAST(secs AS INTEGER) AS VARCHAR), 2, '0') AS date_taken,
  round(1 / p_size, 9) AS exposure_time, 'f/' || CAST(p_size / 10 AS VARCHAR) AS f_number,
  CAST(p_size * 100 AS VARCHAR) AS iso, p_size || '.0mm' AS focal_length,
  round((deg + mins / 60 + secs / 3600) * CASE WHEN hemisphere = 'S' THEN -1 ELSE 1 END, 4) AS latitude,
  round((deg + mins / 60 + secs / 3600) * CASE WHEN hemisphere = 'W' THEN -1 ELSE 1 END, 4) AS longitude,
  round_even(p_partkey / 4 * CASE WHEN altitude_ref = 1 THEN -1 ELSE 1 END, 2) AS altitude
FROM (SELECT c.*, p.p_size FROM camera c JOIN part p ON p.p_partkey = c.p_partkey)""",
    "camera",
)

# ---- children of files ----


def _boxes(spark, sf_dir):
    """A tree with one container file per supplier: the turns of the conversation of its number as
    pages, its line items as pixels, the embeddings of its label as arrays; the folder."""
    pages = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("box")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]).alias("pages")
    )
    pixels = view(spark, sf_dir, "pixels").groupBy(F.col("image_id").alias("box")).agg(
        F.collect_list(F.array("r", "g", "b")).alias("pixels")
    ).withColumns({"width": F.size("pixels"), "height": F.lit(1)})
    arrays = table(spark, sf_dir, "embeddings").groupBy(F.col("label").cast("long").alias("box")).agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.concat(F.lit("v"), "vec_id"), F.col("embedding").cast("array<double>")))
        ).alias("arrays")
    )
    box = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("box"), F.lit(1).alias("version"))
    folder = f"{work_dir(spark)}/{uuid.uuid4().hex}/boxes"
    whole = box.join(pages, "box", "left").join(pixels, "box", "left").join(arrays, "box", "left")
    # One file per box: a box is one row.
    whole.repartition(wide(spark), "box").write.partitionBy("box").json(folder)
    return folder


def merge_children(spark, sf_dir):
    """From files to records that carry the profiles of their pages, pixels and arrays."""
    catalog = sm.build_catalog(
        spark, _boxes(spark, sf_dir), select={"exclude_globs": ["_SUCCESS"]}, containers=[".json"], tabular=False
    )
    return catalog.select(
        F.regexp_extract("path", "/box=([0-9]+)/", 1).cast("long").alias("box"),
        "mime_type", "json_valid", "pages.page_count", "pages.text_preview", "pages.word_count",
        F.col("pages.char_count").alias("page_chars"), "image.width", "image.aspect_ratio", "image.pixel_count",
        "image.hex", "image.brightness",
        F.array_join(F.transform("image.dominant", lambda d: F.concat_ws(" ", d["hex"], d["percentage"])), ",").alias("dominant"),
        "arrays.total_datasets", "arrays.total_elements", "arrays.total_size_bytes",
        F.round("arrays.min", 6).alias("low"), F.round("arrays.max", 6).alias("high"), F.round("arrays.mean", 6).alias("mean"),
    )


QUERIES["merge_children"] = merge_children
ORACLES["merge_children"] = with_views(
    r""", p AS (SELECT conv_id, count(*) AS page_count, string_agg(text || chr(10) || chr(10), '' ORDER BY turn) AS t
  FROM conversations GROUP BY conv_id),
c AS (SELECT image_id, count(*) AS width, CAST(round_even(avg(r), 0) AS INTEGER) AS r,
    CAST(round_even(avg(g), 0) AS INTEGER) AS g, CAST(round_even(avg(b), 0) AS INTEGER) AS b FROM pixels GROUP BY image_id),
d AS (SELECT image_id, string_agg(printf('#%02x%02x%02x', r, g, b) || ' ' || round_even(n / total * 100, 2), ',' ORDER BY rank)
    AS dominant
  FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, r, g, b) AS rank,
               sum(n) OVER (PARTITION BY image_id)::DOUBLE AS total
        FROM (SELECT image_id, r, g, b, count(*) AS n FROM pixels GROUP BY ALL))
  WHERE rank <= 5 GROUP BY image_id),
a AS (SELECT label, count(*) AS total_datasets, sum(len(embedding))::BIGINT AS total_elements,
    min(list_min(embedding::DOUBLE[])) AS low, max(list_max(embedding::DOUBLE[])) AS high,
    sum(list_sum(embedding::DOUBLE[])) / sum(len(embedding)) AS mean FROM embeddings GROUP BY label)
SELECT s_suppkey AS box, 'application/json' AS mime_type, true AS json_valid, page_count,
  CASE WHEN length(t) > 10000 THEN substr(t, 1, 10000) || '...' ELSE t END AS text_preview,
  len(regexp_extract_all(t, '[\p{L}\p{N}_]+')) AS word_count, length(t) AS page_chars, width,
  width::DOUBLE AS aspect_ratio, width AS pixel_count, printf('#%02x%02x%02x', r, g, b) AS hex,
  round_even((0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b) / 255, 2) AS brightness, dominant,
  total_datasets, total_elements, total_elements * 8 AS total_size_bytes,
  round(low, 6) AS low, round(high, 6) AS high, round(mean, 6) AS mean
FROM supplier LEFT JOIN p ON conv_id = s_suppkey LEFT JOIN c ON c.image_id = s_suppkey
LEFT JOIN d ON d.image_id = s_suppkey LEFT JOIN a ON label = s_suppkey""",
    "pixels",
)

# ---- paged documents -----------------------------------------------------------------------

QUERIES["page_count"] = lambda spark, sf_dir: sm.page_count(
    table(spark, sf_dir, "conversations"), "conv_id"
)
ORACLES["page_count"] = "SELECT conv_id, count(*) AS page_count FROM conversations GROUP BY conv_id"

QUERIES["join_first_pages"] = lambda spark, sf_dir: sm.join_first_pages(
    table(spark, sf_dir, "conversations"), "conv_id", "turn"
)
_JOINED = """(SELECT conv_id, string_agg(text || chr(10) || chr(10), '' ORDER BY turn) AS text
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)
  WHERE rn <= 5 GROUP BY conv_id)"""
ORACLES["join_first_pages"] = f"SELECT conv_id, text FROM {_JOINED}"

QUERIES["page_text_stats"] = lambda spark, sf_dir: sm.page_text_stats(
    table(spark, sf_dir, "conversations"), "conv_id", "turn"
)
ORACLES["page_text_stats"] = rf"""SELECT conv_id,
  CASE WHEN length(text) > 10000 THEN substr(text, 1, 10000) || '...' ELSE text END AS text_preview,
  len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS word_count, length(text) AS char_count
FROM (SELECT conv_id, string_agg(text || chr(10) || chr(10), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"""

QUERIES["any_in_first_pages"] = lambda spark, sf_dir: sm.any_in_first_pages(
    table(spark, sf_dir, "conversations").withColumn("long", F.length("text") > 400),
    "conv_id", "turn", "long",
)
ORACLES["any_in_first_pages"] = """SELECT conv_id, bool_or(length(text) > 400) AS any_page
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)
WHERE rn <= 3 GROUP BY conv_id"""

QUERIES["parse_compact_date"] = lambda spark, sf_dir: view(spark, sf_dir, "compact_dates").select(
    "o_orderkey", compact_date(F.col("stamp")).alias("at")
)
ORACLES["parse_compact_date"] = with_views(
    r"""SELECT o_orderkey, try_strptime(regexp_extract(stamp, '^(D:)?(\d{14})', 2), '%Y%m%d%H%M%S') AS at
FROM compact_dates""",
    "compact_dates",
)

# ---- source code -----------------------------------------------------------------------------

QUERIES["comment_stats"] = lambda spark, sf_dir: sm.comment_stats(
    view(spark, sf_dir, "modules")
).select("path", "comment_lines", "comment_ratio")
ORACLES["comment_stats"] = with_views(
    f"""SELECT path, c AS comment_lines, round_even(c / n, 2) AS comment_ratio
FROM (SELECT path, {LINES} AS n,
        CAST(len(list_filter(string_split(content, chr(10)), lambda l: l LIKE '#%' OR ltrim(l) LIKE '#%')) AS BIGINT) AS c
      FROM modules)""",
    "modules",
)

_OK = "p_partkey % 11 <> 0"


def code_symbols(spark, sf_dir):
    rows = sm.code_symbols(view(spark, sf_dir, "modules"))
    parameters = F.transform(
        "parameters",
        lambda p: F.concat(p["name"], F.coalesce(F.concat(F.lit(":"), p["annotation"]), F.lit(""))),
    )
    return rows.select(
        "path", "kind", "name", "parent", "line", "end_line", "visibility", "value_type",
        F.array_join("bases", ",").alias("bases"), F.array_join(parameters, ",").alias("parameters"),
    )


QUERIES["code_symbols"] = code_symbols


def _symbol(kind, name, parent, line, end, seen, value_type, bases, parameters):
    q = lambda v: "CAST(NULL AS VARCHAR)" if v is None else v
    n = "CAST(NULL AS BIGINT)" if end is None else f"CAST({end} AS BIGINT)"
    return f"""SELECT path, '{kind}' AS kind, {name} AS name, {q(parent)} AS parent, CAST({line} AS BIGINT) AS line,
  {n} AS end_line, {q(seen)} AS visibility, {q(value_type)} AS value_type, {q(bases)} AS bases,
  {q(parameters)} AS parameters FROM modules WHERE {_OK}"""


ORACLES["code_symbols"] = with_views(
    "\nUNION ALL\n".join(
        [
            _symbol("variable", "'LIMIT'", None, 6, None, None, "'num'", None, None),
            _symbol("class", "'P' || p_partkey", None, 8, 14, None, None, "'core.Base'", None),
            _symbol("method", "'__init__'", "'P' || p_partkey", 9, 10, "'special'", None, None, "'self,x:int'"),
            _symbol("method", "'_hidden'", "'P' || p_partkey", 12, 14, "'private'", None, None, "'self'"),
            _symbol("function", "'run'", None, 16, 21, "'public'", None, None, "'n'"),
        ]
    ),
    "modules",
)


def _imports(spark, sf_dir):
    return sm.code_imports(view(spark, sf_dir, "modules"), local_prefixes=["economy"])


QUERIES["code_imports"] = lambda spark, sf_dir: _imports(spark, sf_dir).select(
    "path", "module", "class", "text"
)
ORACLES["code_imports"] = with_views(
    f"""SELECT path, 'os.path' AS module, 'standard_library' AS class, 'os.path' AS text FROM modules WHERE {_OK}
UNION ALL SELECT path, lower(p_type) || '.core',
  CASE WHEN p_type = 'ECONOMY' THEN 'local' ELSE 'third_party' END, lower(p_type) || '.core' FROM modules WHERE {_OK}
UNION ALL SELECT path, 'pkg', 'local', '..pkg -> a, b' FROM modules WHERE {_OK}""",
    "modules",
)

QUERIES["import_frequency"] = lambda spark, sf_dir: sm.import_frequency(_imports(spark, sf_dir))
ORACLES["import_frequency"] = with_views(
    f"""SELECT module, count(*) AS n FROM (
  SELECT 'os.path' AS module FROM modules WHERE {_OK}
  UNION ALL SELECT lower(p_type) || '.core' FROM modules WHERE {_OK}
  UNION ALL SELECT 'pkg' FROM modules WHERE {_OK}) GROUP BY module""",
    "modules",
)

QUERIES["code_complexity"] = lambda spark, sf_dir: sm.code_complexity(view(spark, sf_dir, "modules"))
ORACLES["code_complexity"] = with_views(
    f"""SELECT path, CAST(11 AS BIGINT) AS statement_count, CAST(1 AS BIGINT) AS n_if, CAST(1 AS BIGINT) AS n_for,
  CAST(1 AS BIGINT) AS n_while, CAST(0 AS BIGINT) AS n_try, CAST(4 AS BIGINT) AS cyclomatic_complexity
FROM modules WHERE {_OK}""",
    "modules",
)
