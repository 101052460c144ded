"""Sources, path predicates, identity, routing and merging."""

from __future__ import annotations

import uuid

import shelfmark as sm
from pyspark.sql import functions as F
from shelfmark.functions import text as text_functions
from shelfmark.operators.routing import Registry
from shelfmark.operators.semistructured import json_judgement, json_struct
from shelfmark.session import work_dir

from .views import table, view, with_views

QUERIES, ORACLES = {}, {}


def _files(spark, sf_dir):
    return sm.files_from_table(view(spark, sf_dir, "files"))


def _work_path(spark, name):
    return f"{work_dir(spark)}/{uuid.uuid4().hex}/{name}"


SHARDS = 4


def _written_tree(spark, sf_dir):
    """Documents written out as text files and parts as comma-separated ones; the folder."""
    folder = _work_path(spark, "tree")
    shard = F.pmod(F.col("doc_id"), F.lit(SHARDS)).alias("shard")
    docs = table(spark, sf_dir, "documents").select("source", shard, "doc_id", "text")
    dealt = docs.repartition("source", "shard").sortWithinPartitions("source", "shard", "doc_id")
    dealt.drop("doc_id").write.partitionBy("source", "shard").text(f"{folder}/texts")
    parts = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", "p_type").repartition("p_brand")
    parts.sortWithinPartitions("p_brand").write.partitionBy("p_brand").option("header", True).csv(f"{folder}/tables")
    return folder


def _file_key():
    return F.regexp_extract("path", r"/((?:source|p_brand)=[^/]+(?:/shard=[0-9]+)?)/[^/]*$", 1).alias("file_key")


_TREE = f"""WITH texts AS (
  SELECT 'source=' || source || '/shard=' || doc_id % {SHARDS} AS file_key,
         string_agg(text || chr(10), '' ORDER BY doc_id) AS content
  FROM documents GROUP BY source, doc_id % {SHARDS}),
tables AS (
  SELECT 'p_brand=' || replace(p_brand, '#', '%23') AS file_key, count(*) AS n, min(p_size) AS low, max(p_size) AS high,
         sum(length(p_partkey || ',' || p_size || ',' || p_type) + 1) + length('p_partkey,p_size,p_type') + 1 AS size_bytes
  FROM part GROUP BY p_brand)"""


def scan_files(spark, sf_dir):
    listed = sm.scan_files(spark, _written_tree(spark, sf_dir))
    return listed.where(F.col("filename") != "_SUCCESS").select(_file_key(), "extension", "size_bytes", "depth")


QUERIES["scan_files"] = scan_files
ORACLES["scan_files"] = _TREE + """
SELECT file_key, '.txt' AS extension, strlen(content) AS size_bytes, CAST(3 AS INTEGER) AS depth FROM texts
UNION ALL SELECT file_key, '.csv', CAST(size_bytes AS BIGINT), 2 FROM tables"""


def scan_changes(spark, sf_dir):
    """Brands with a part larger than 48 are written again between two scans, without it."""
    folder = _written_tree(spark, sf_dir)
    before = sm.scan_files(spark, folder)
    parts = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", "p_type")
    touched = parts.where("p_size > 48").select("p_brand").distinct()
    again = parts.join(touched, "p_brand", "left_semi").where("p_size <= 48").repartition("p_brand")
    again.sortWithinPartitions("p_brand").write.partitionBy("p_brand").option("header", True).option(
        "partitionOverwriteMode", "dynamic"
    ).mode("overwrite").csv(f"{folder}/tables")
    changes = sm.listing_changes(sm.scan_files(spark, folder), before, folder)
    return changes.where(F.col("filename") != "_SUCCESS").select("change", _file_key(), "size_bytes")


QUERIES["scan_changes"] = scan_changes
ORACLES["scan_changes"] = """WITH lines AS (
  SELECT p_brand, p_size, length(p_partkey || ',' || p_size || ',' || p_type) + 1 AS n FROM part),
sizes AS (
  SELECT 'p_brand=' || replace(p_brand, '#', '%23') AS file_key, max(p_size) AS largest, sum(n) AS old_size,
    sum(CASE WHEN p_size <= 48 THEN n ELSE 0 END) AS new_size, length('p_partkey,p_size,p_type') + 1 AS head
  FROM lines GROUP BY p_brand)
SELECT 'removed' AS change, file_key, CAST(old_size + head AS BIGINT) AS size_bytes FROM sizes WHERE largest > 48
UNION ALL SELECT 'added', file_key, CAST(new_size + head AS BIGINT) FROM sizes WHERE largest > 48 AND new_size > 0"""


def build_catalog_tree(spark, sf_dir):
    """The whole job over real files: list, select, read, profile, merge."""
    catalog = sm.build_catalog(spark, _written_tree(spark, sf_dir), select={"exclude_globs": ["_SUCCESS"]})
    size = F.col("sample_statistics")["p_size"]
    return catalog.select(
        _file_key(), F.col("file.size_bytes").alias("size_bytes"), "mime_type", "format",
        F.when(F.col("format").isNull(), F.col("word_count")).alias("word_count"),
        F.when(F.col("format").isNull(), F.col("line_count")).alias("line_count"),
        "row_count", "column_count", F.array_join("columns", ",").alias("columns"),
        size["min"].alias("low"), size["max"].alias("high"), F.col("read_error").isNull().alias("was_read"),
    )


QUERIES["build_catalog_tree"] = build_catalog_tree
ORACLES["build_catalog_tree"] = _TREE + r"""
SELECT file_key, strlen(content) AS size_bytes, 'text/plain' AS mime_type, NULL AS format,
  len(regexp_extract_all(content, '[\p{L}\p{N}_]+')) AS word_count,
  length(content) - length(replace(content, chr(10), '')) + 1 AS line_count, CAST(NULL AS BIGINT) AS row_count,
  CAST(NULL AS BIGINT) AS column_count, NULL AS columns, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high,
  true AS was_read FROM texts
UNION ALL SELECT file_key, CAST(size_bytes AS BIGINT), 'text/csv', 'csv', NULL, NULL, n, 3,
  'p_partkey,p_size,p_type', low, high, true FROM tables"""


def files_from_table(spark, sf_dir):
    return _files(spark, sf_dir).select(
        "path", "filename", "directory", "extension", "size_bytes", "depth"
    )


QUERIES["files_from_table"] = files_from_table
ORACLES["files_from_table"] = with_views(
    """SELECT path, string_split(path, '/')[-1] AS filename,
       substr(path, 1, length(path) - length(string_split(path, '/')[-1]) - 1) AS directory,
       '.' || string_split(path, '.')[-1] AS extension, strlen(content) AS size_bytes,
       CAST(len(string_split(path, '/')) - 2 AS INTEGER) AS depth
FROM files""",
    "files",
)


def read_text_content(spark, sf_dir):
    # Windows line ends are made first, so that there is something to normalise.
    raw = view(spark, sf_dir, "files").withColumn(
        "content", F.replace("content", F.lit("\n"), F.lit("\r\n")).cast("binary")
    )
    return sm.read_text_content(raw).select("path", F.md5("content").alias("digest"))


QUERIES["read_text_content"] = read_text_content
ORACLES["read_text_content"] = with_views(
    "SELECT path, md5(content) AS digest FROM files", "files"
)


def read_delimited(spark, sf_dir):
    path = _work_path(spark, "part.csv")
    table(spark, sf_dir, "part").write.option("header", True).csv(path)
    back = sm.read_delimited(spark, path)
    return back.withColumn("p_retailprice", F.col("p_retailprice").cast("double"))


QUERIES["read_delimited"] = read_delimited
ORACLES["read_delimited"] = """SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, p_brand,
       p_type, CAST(p_size AS VARCHAR) AS p_size, p_retailprice FROM part"""


def read_json_records(spark, sf_dir):
    # One array of objects per file, as a JSON export would have it.
    path = _work_path(spark, "part.json")
    lines = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    arrays = lines.groupBy(F.floor(F.col("p_partkey") / 500)).agg(
        F.to_json(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name", "p_size")))).alias("value")
    )
    arrays.select("value").repartition("value").write.option("maxRecordsPerFile", 1).text(path)
    return sm.read_json_records(spark, path)


QUERIES["read_json_records"] = read_json_records
ORACLES["read_json_records"] = """SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name,
       CAST(p_size AS VARCHAR) AS p_size FROM part"""


def catalog_json_round_trip(spark, sf_dir):
    catalog = sm.text_profile(sm.basic_metadata(_files(spark, sf_dir))).select(
        "path", "file", "mime_type", "line_count", "keywords", "modified_at"
    )
    folder = _work_path(spark, "catalog")
    sm.write_catalog_json(catalog, folder)
    back = sm.read_catalog_json(spark, folder, catalog.schema)
    return back.select(
        "path", "file.filename", "file.size_bytes", "mime_type", "line_count",
        F.size("keywords").cast("long").alias("n_keywords"),
    )


WORDS = r"regexp_extract_all(lower(content), '[\p{L}\p{N}_]+')"
STOP = "['the','and','is','in','to','of','that','for','on','with','as','this','by']"
MIME = """CASE string_split(path, '.')[-1] WHEN 'txt' THEN 'text/plain' WHEN 'md' THEN 'text/markdown'
       WHEN 'csv' THEN 'text/csv' WHEN 'json' THEN 'application/json' WHEN 'py' THEN 'text/x-python' END"""
LINES = "length(content) - length(replace(content, chr(10), '')) + 1"

QUERIES["catalog_json_round_trip"] = catalog_json_round_trip
ORACLES["catalog_json_round_trip"] = with_views(
    f"""SELECT path, string_split(path, '/')[-1] AS filename, strlen(content) AS size_bytes,
       {MIME} AS mime_type, {LINES} AS line_count,
       least(10, len(list_distinct(list_filter({WORDS},
             lambda w: length(w) >= 3 AND NOT list_contains({STOP}, w))))) AS n_keywords
FROM files""",
    "files",
)


def to_index_schema(spark, sf_dir):
    catalog = sm.text_profile(sm.basic_metadata(_files(spark, sf_dir)))
    return sm.to_index_schema(catalog).withColumn("keywords", F.array_join("keywords", " "))


QUERIES["to_index_schema"] = to_index_schema

KEYWORDS_SQL = f"""tokens AS (
  SELECT path, unnest(ws) AS word, unnest(range(len(ws))) AS pos
  FROM (SELECT path, {WORDS} AS ws FROM files)),
counted AS (
  SELECT path, word, count(*) AS n, min(pos) AS pos FROM tokens
  WHERE length(word) >= 3 AND NOT list_contains({STOP}, word) GROUP BY path, word),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, pos) AS rank FROM counted),
keywords AS (
  SELECT path, string_agg(word, ' ' ORDER BY rank) AS keywords FROM ranked WHERE rank <= 10
  GROUP BY path),
hits AS (
  SELECT path,
    count(*) FILTER (word IN ('the','and','is','in','to','of','that','for')) AS en,
    count(*) FILTER (word IN ('el','la','es','en','y','de','que','por')) AS es,
    count(*) FILTER (word IN ('le','la','est','en','et','de','que','pour')) AS fr
  FROM tokens GROUP BY path),
spoken AS (
  SELECT path, CASE WHEN en > es AND en > fr THEN 'en' WHEN es > en AND es > fr THEN 'es'
                    WHEN fr > en AND fr > es THEN 'fr' ELSE 'unknown' END AS language
  FROM hits)"""


def files_text_sql(select: str) -> str:
    """Files with keywords and language in front of a select."""
    return with_views("", "files").rstrip() + ",\n" + KEYWORDS_SQL + "\n" + select


ORACLES["to_index_schema"] = files_text_sql(
    f"""SELECT f.path, string_split(f.path, '/')[-1] AS filename,
       '.' || string_split(f.path, '.')[-1] AS extension, strlen(content) AS size_bytes,
       CAST(NULL AS TIMESTAMP) AS created_at, CAST(NULL AS TIMESTAMP) AS modified_at,
       CAST(NULL AS TIMESTAMP) AS accessed_at, {MIME.replace('path', 'f.path')} AS mime_type,
       CAST(NULL AS VARCHAR) AS encoding, substr(content, 1, 1000) AS content_preview,
       CAST({LINES} AS INTEGER) AS line_count, CAST(len({WORDS}) AS INTEGER) AS word_count,
       CAST(length(content) AS INTEGER) AS char_count,
       coalesce(language, 'unknown') AS language, coalesce(keywords, '') AS keywords
FROM files f LEFT JOIN keywords k ON k.path = f.path LEFT JOIN spoken s ON s.path = f.path"""
)

# ---- path predicates ---------------------------------------------------------------

SELECT_RULES = {
    "exclude_glob": lambda f: sm.exclude_glob(f, ["src1*", "*.csv", ".cache/fr"]),
    "exclude_regex": lambda f: sm.exclude_regex(f, [r"/src\d5$", r"/fr$", r"_\d*7\.md$"]),
    "include_paths": lambda f: sm.include_paths(
        f, globs=["*.md", "en/doc_1*.txt"], regexes=[r"/de/.*5\.\w+$"]
    ),
    "exclude_dot_paths": sm.exclude_dot_paths,
    "limit_depth": lambda f: sm.limit_depth(f, 2),
    "select_files": lambda f: sm.select_files(
        f,
        exclude_globs=["src1*", "*.csv"],
        exclude_regexes=[r"/fr$"],
        include_globs=["*.md", "*.txt"],
        include_regexes=[r"/de/"],
        max_depth=2,
    ),
}
_PARTS = "string_split(path, '/')"
GLOB_OUT = (
    f"len(list_filter({_PARTS}, lambda p: p LIKE 'src1%' OR p LIKE '%.csv')) > 0"
)
SELECT_WHERE = {
    "exclude_glob": f"NOT ({GLOB_OUT}) AND NOT (path LIKE '%/.cache/fr/%')",
    "exclude_regex": (
        f"NOT ({_PARTS}[2] SIMILAR TO 'src[0-9]5') AND NOT list_contains({_PARTS}, 'fr')"
        r" AND NOT regexp_matches(path, '_[0-9]*7\.md$')"
    ),
    "include_paths": (
        "path LIKE '%.md' OR (path LIKE '%/en/doc_1%' AND path LIKE '%.txt')"
        r" OR regexp_matches(path, '/de/.*5\.\w+$')"
    ),
    "exclude_dot_paths": "path NOT LIKE '%/.%'",
    "limit_depth": f"len({_PARTS}) - 2 <= 2",
    "select_files": (
        f"path NOT LIKE '%/.%' AND len({_PARTS}) - 2 <= 2 AND NOT ({GLOB_OUT})"
        f" AND NOT list_contains({_PARTS}, 'fr')"
        " AND (path LIKE '%.md' OR path LIKE '%.txt' OR path LIKE '%/de/%')"
    ),
}
for _name, _rule in SELECT_RULES.items():
    QUERIES[_name] = lambda spark, sf_dir, rule=_rule: rule(
        view(spark, sf_dir, "files").select("path")
    )
    ORACLES[_name] = with_views(f"SELECT path FROM files WHERE {SELECT_WHERE[_name]}", "files")

# ---- identity, routing, merging ------------------------------------------------------


def file_identity(spark, sf_dir):
    return sm.file_identity(sm.files_from_table(view(spark, sf_dir, "page_files"))).select(
        "path", "file.*"
    )


QUERIES["file_identity"] = file_identity
ORACLES["file_identity"] = with_views(
    r"""SELECT path, regexp_extract(path, '([^/]*)$', 1) AS filename,
       regexp_replace(path, '/[^/]*$', '') AS directory,
       lower(regexp_extract(path, '[^/](\.[^./]+)$', 1)) AS extension,
       strlen(content) AS size_bytes
FROM page_files""",
    "page_files",
)

PART_MIME = """CASE p_partkey % 9 WHEN 0 THEN 'application/x-tar' WHEN 1 THEN 'application/x-tar'
       WHEN 2 THEN 'text/csv' WHEN 3 THEN 'image/png' WHEN 4 THEN 'application/pdf'
       WHEN 7 THEN 'application/json' ELSE 'application/octet-stream' END"""
PART_ENCODING = "CASE p_partkey % 9 WHEN 0 THEN 'gzip' WHEN 1 THEN 'gzip' WHEN 7 THEN 'bzip2' END"
PART_NAME = "string_split(path, '/')[-1]"
PART_SUFFIX = """CASE p_partkey % 9 WHEN 0 THEN '.gz' WHEN 1 THEN '.tgz' WHEN 2 THEN '.csv'
       WHEN 3 THEN '.png' WHEN 4 THEN '.pdf' WHEN 5 THEN '.unknown' WHEN 7 THEN '.bz2' ELSE '' END"""


def basic_metadata(spark, sf_dir):
    return sm.basic_metadata(view(spark, sf_dir, "part_files")).select(
        "path", "file.filename", "file.extension", "file.size_bytes", "created_at",
        "modified_at", "accessed_at", "mime_type", "encoding",
    )


QUERIES["basic_metadata"] = basic_metadata
ORACLES["basic_metadata"] = with_views(
    f"""SELECT path, {PART_NAME} AS filename, {PART_SUFFIX} AS extension, size_bytes,
       CAST(NULL AS TIMESTAMP) AS created_at, CAST(NULL AS TIMESTAMP) AS modified_at,
       CAST(NULL AS TIMESTAMP) AS accessed_at, {PART_MIME} AS mime_type,
       {PART_ENCODING} AS encoding
FROM part_files""",
    "part_files",
)

QUERIES["guess_mime"] = lambda spark, sf_dir: sm.guess_mime(
    view(spark, sf_dir, "part_files")
).groupBy("mime_type", "encoding").agg(F.count("*").alias("n"))
ORACLES["guess_mime"] = with_views(
    f"""SELECT {PART_MIME} AS mime_type, {PART_ENCODING} AS encoding, count(*) AS n
FROM part_files GROUP BY 1, 2""",
    "part_files",
)


def route_extractors(spark, sf_dir):
    paths = view(spark, sf_dir, "files").select("path").unionByName(
        view(spark, sf_dir, "part_files").select("path")
    )
    routed = sm.route_extractors(sm.guess_mime(paths), Registry())
    return routed.select("path", F.array_join("profiles", ",").alias("profiles"))


QUERIES["route_extractors"] = route_extractors
ORACLES["route_extractors"] = with_views(
    """SELECT path, CASE string_split(path, '.')[-1] WHEN 'csv' THEN 'text,tabular'
       WHEN 'json' THEN 'text,tabular,json' WHEN 'py' THEN 'text,python' ELSE 'text' END AS profiles
FROM files
UNION ALL
SELECT path, CASE p_partkey % 9 WHEN 2 THEN 'text,tabular' WHEN 3 THEN 'image'
       WHEN 4 THEN 'pdf' WHEN 7 THEN 'json' ELSE '' END AS profiles
FROM part_files""",
    "files",
    "part_files",
)


def merge_profiles(spark, sf_dir):
    content, is_json = F.col("content"), F.endswith("path", F.lit(".json"))
    first = F.struct(
        F.substring(content, 1, 20).alias("content_preview"),
        text_functions.line_count(content).alias("line_count"),
    )
    later = F.struct(
        F.substring(content, 1, 5).alias("content_preview"),
        F.length(content).cast("long").alias("json_size"),
        F.struct(F.lit("hidden").alias("filename"), F.lit(1).alias("links")).alias("file"),
    )
    rows = sm.file_identity(_files(spark, sf_dir)).select(
        "path", "file", first.alias("first"), F.when(is_json, later).alias("later")
    )
    return sm.merge_profiles(rows, ["first", "later"]).select(
        "path", "file.filename", F.col("file.links").alias("links"),
        "content_preview", "line_count", "json_size",
    )


QUERIES["merge_profiles"] = merge_profiles
ORACLES["merge_profiles"] = with_views(
    f"""SELECT path, {PART_NAME} AS filename, CASE WHEN path LIKE '%.json' THEN 1 END AS links,
       CASE WHEN path LIKE '%.json' THEN substr(content, 1, 5) ELSE substr(content, 1, 20) END
           AS content_preview,
       {LINES} AS line_count, CASE WHEN path LIKE '%.json' THEN length(content) END AS json_size
FROM files""",
    "files",
)


def extraction_errors(spark, sf_dir):
    rows = view(spark, sf_dir, "json_rows").select(
        "p_partkey",
        json_struct(F.col("content"), json_judgement(F.col("content"))).alias("json"),
        F.struct(
            F.when(F.length("content") > 60, F.lit("too long")).alias("error")
        ).alias("size"),
    )
    errors = sm.extraction_errors(rows, ["json", "size"], key="p_partkey")
    return sm.count_errors(errors)


QUERIES["extraction_errors"] = extraction_errors
ORACLES["extraction_errors"] = with_views(
    """SELECT profile, count(*) AS n_failed FROM (
  SELECT 'json' AS profile FROM json_rows WHERE NOT json_valid(content)
  UNION ALL SELECT 'size' FROM json_rows WHERE length(content) > 60) GROUP BY profile""",
    "json_rows",
)


def register_extractor(spark, sf_dir):
    registry = Registry()
    registry.register_extractor(
        "capitals",
        suffixes=[".md"],
        mime_prefixes=["application/json"],
        fn=lambda content: F.when(
            content.isNotNull(),
            F.struct(F.regexp_count(content, F.lit("[A-Z]")).cast("long").alias("n_capitals")),
        ),
    )
    catalog = sm.catalog_from_files(_files(spark, sf_dir), registry=registry, tabular=False)
    return catalog.select("path", F.get("profiles", F.size("profiles") - 1).alias("last"), "n_capitals")


QUERIES["register_extractor"] = register_extractor
ORACLES["register_extractor"] = with_views(
    """SELECT path, CASE string_split(path, '.')[-1] WHEN 'md' THEN 'capitals' WHEN 'json' THEN 'capitals'
         WHEN 'csv' THEN 'tabular' WHEN 'py' THEN 'python' ELSE 'text' END AS last,
       CASE WHEN path LIKE '%.md' OR path LIKE '%.json'
            THEN len(regexp_extract_all(content, '[A-Z]')) END AS n_capitals
FROM files WHERE path NOT LIKE '%/.%'""",
    "files",
)
