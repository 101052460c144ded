"""Entries, index upkeep and search over the catalog of the given documents and pages."""

from __future__ import annotations

import uuid

import shelfmark as sm
from pyspark.sql import functions as F
from shelfmark.session import work_dir

from .selection_queries import LINES, MIME, files_text_sql
from .views import table, view, with_views

QUERIES, ORACLES = {}, {}


def _file_catalog(spark, sf_dir):
    """Documents as a plain catalog, without text profile."""
    return sm.file_identity(sm.files_from_table(view(spark, sf_dir, "files"))).select("path", "file")


def _old_entries(spark, sf_dir):
    """All documents, published to everybody."""
    return sm.to_entries(_file_catalog(spark, sf_dir))


def _new_entries(spark, sf_dir):
    """The labelled documents again, for reviewers only, and all pages."""
    labelled = (
        sm.files_from_table(view(spark, sf_dir, "files"))
        .join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    )
    pages = sm.files_from_table(view(spark, sf_dir, "page_files"))
    docs = sm.file_identity(labelled).select("path", "file")
    return sm.to_entries(docs, visible_to=["reviewers"]).unionByName(
        sm.to_entries(sm.file_identity(pages).select("path", "file"))
    )


def _flat(entries):
    return entries.select(
        "subject", F.array_join("visible_to", ",").alias("visible_to"),
        F.col("content.file.filename").alias("filename"),
        F.col("content.file.size_bytes").alias("size_bytes"),
    )


_ENTRY_VIEWS = ("files", "page_files")
_NAME = "string_split(path, '/')[-1] AS filename, strlen(content) AS size_bytes"
_OLD = f"old_entries AS (SELECT 'file://' || path AS subject, 'public' AS visible_to, {_NAME} FROM files)"
_NEW = f"""new_entries AS (
  SELECT 'file://' || path AS subject, 'reviewers' AS visible_to, {_NAME} FROM files
  WHERE doc_id IN (SELECT doc_id FROM labels)
  UNION ALL SELECT 'file://' || path, 'public', {_NAME} FROM page_files)"""


def _entry_sql(select: str) -> str:
    return with_views("", *_ENTRY_VIEWS).rstrip() + f",\n{_OLD},\n{_NEW}\n{select}"


QUERIES["to_entries"] = lambda spark, sf_dir: _flat(_old_entries(spark, sf_dir))
ORACLES["to_entries"] = _entry_sql("SELECT * FROM old_entries")


def upsert_entries(spark, sf_dir):
    # Published twice, so that repeated incoming keys are part of the work.
    new = _new_entries(spark, sf_dir).withColumn("published", F.lit(2))
    stale = new.withColumns(
        {"visible_to": F.array(F.lit("nobody")), "published": F.lit(1)}
    )
    old = _old_entries(spark, sf_dir).withColumn("published", F.lit(0))
    return _flat(sm.upsert_entries(old, stale.unionByName(new), order_by=["published"]))


QUERIES["upsert_entries"] = upsert_entries
ORACLES["upsert_entries"] = _entry_sql(
    """SELECT * FROM old_entries WHERE subject NOT IN (SELECT subject FROM new_entries)
UNION ALL SELECT * FROM new_entries"""
)

QUERIES["latest_per_key"] = lambda spark, sf_dir: sm.latest_per_key(
    table(spark, sf_dir, "conversations"), "conv_id", ["turn"]
)
ORACLES["latest_per_key"] = """SELECT conv_id, turn, role, text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1"""

QUERIES["delete_entries"] = lambda spark, sf_dir: _flat(
    sm.delete_entries(_old_entries(spark, sf_dir), _new_entries(spark, sf_dir))
)
ORACLES["delete_entries"] = _entry_sql(
    "SELECT * FROM old_entries WHERE subject NOT IN (SELECT subject FROM new_entries)"
)

QUERIES["batch_entries"] = lambda spark, sf_dir: sm.batch_entries(
    _old_entries(spark, sf_dir), n=20, rows_per_bucket=100
).select("subject", "bucket", "batch_no")
ORACLES["batch_entries"] = _entry_sql(
    """SELECT subject, bucket, (row_number() OVER (PARTITION BY bucket ORDER BY subject) - 1) // 20 AS batch_no
FROM (SELECT subject, CAST('0x' || substr(md5(subject), 1, 8) AS BIGINT)
        % (SELECT CAST(ceil(count(*) / 100) AS BIGINT) FROM old_entries) AS bucket
      FROM old_entries)"""
)

QUERIES["number_batches"] = lambda spark, sf_dir: sm.number_batches(
    _old_entries(spark, sf_dir), n=20, rows_per_bucket=100
).select("subject", "batch_no")
ORACLES["number_batches"] = _entry_sql(
    """SELECT subject, (row_number() OVER (ORDER BY bucket, subject) - 1) // 20 AS batch_no
FROM (SELECT subject, CAST('0x' || substr(md5(subject), 1, 8) AS BIGINT)
        % (SELECT CAST(ceil(count(*) / 100) AS BIGINT) FROM old_entries) AS bucket
      FROM old_entries)"""
)


def publish_summary(spark, sf_dir):
    entries = _old_entries(spark, sf_dir).withColumn(
        "subject",
        F.when(F.col("content.file.extension") == ".py", F.lit(""))
        .when(F.col("content.file.extension") != ".csv", F.col("subject")),
    )
    return sm.publish_summary(entries)


QUERIES["publish_summary"] = publish_summary
ORACLES["publish_summary"] = with_views(
    """SELECT count(*) FILTER (path NOT LIKE '%.py' AND path NOT LIKE '%.csv') AS succeeded,
  count(*) FILTER (path LIKE '%.py' OR path LIKE '%.csv') AS failed FROM files""",
    "files",
)

# A document of the plain listing (not below .cache); labelled ones have an old and a new entry.
_SOUGHT = "file:///src1/en/doc_1.md"
QUERIES["get_entry"] = lambda spark, sf_dir: _flat(
    sm.get_entry(_new_entries(spark, sf_dir).unionByName(_old_entries(spark, sf_dir)), _SOUGHT)
)
ORACLES["get_entry"] = _entry_sql(
    """SELECT * FROM (SELECT * FROM old_entries UNION ALL SELECT * FROM new_entries)
WHERE subject = '""" + _SOUGHT + "'"
)

QUERIES["index_stats"] = lambda spark, sf_dir: sm.index_stats(
    _old_entries(spark, sf_dir).select(
        "subject", "visible_to",
        F.struct("content.path", "content.file.filename", "content.file.size_bytes").alias("content"),
    )
)
ORACLES["index_stats"] = _entry_sql(
    """SELECT count(*) AS doc_count, CAST(sum(strlen(to_json({'subject': 'file://' || path, 'visible_to': ['public'],
  'content': {'path': path, 'filename': string_split(path, '/')[-1], 'size_bytes': strlen(content)}}))) AS BIGINT)
  AS index_size_bytes FROM files"""
)

QUERIES["lookup_entry"] = lambda spark, sf_dir: _flat(
    sm.lookup_entry(spark, _stored_index(spark, sf_dir), _SOUGHT)
)
ORACLES["lookup_entry"] = _entry_sql(
    "SELECT * FROM new_entries WHERE visible_to = 'reviewers' AND subject = '" + _SOUGHT + "'"
)

QUERIES["visible_entries"] = lambda spark, sf_dir: _flat(
    sm.visible_entries(_new_entries(spark, sf_dir), [])
)
ORACLES["visible_entries"] = _entry_sql("SELECT * FROM new_entries WHERE visible_to = 'public'")

# ---- search over the profiled catalog ----------------------------------------------------------


def _catalog(spark, sf_dir):
    return sm.text_profile(sm.basic_metadata(sm.files_from_table(view(spark, sf_dir, "files"))))


def _search_sql(columns: str, where: str = "true") -> str:
    return files_text_sql(
        f"""SELECT {columns} FROM (SELECT f.path, string_split(f.path, '/')[-1] AS filename,
  substr(f.path, 1, length(f.path) - length(string_split(f.path, '/')[-1]) - 1) AS directory,
  '.' || string_split(f.path, '.')[-1] AS extension, strlen(content) AS size_bytes,
  {MIME.replace('path', 'f.path')} AS mime_type, {LINES} AS line_count,
  substr(content, 1, 1000) AS content_preview,
  coalesce(language, 'unknown') AS language, coalesce(keywords, '') AS keywords
FROM files f LEFT JOIN keywords k ON k.path = f.path LEFT JOIN spoken s ON s.path = f.path)
WHERE {where}"""
    )


FACETS = {
    "Directory": "file.directory",
    "Extension": "file.extension",
    "Language": "language",
    "MIME Type": "mime_type",
    "Keywords": "keywords",
}

QUERIES["term_facets"] = lambda spark, sf_dir: sm.term_facets(_catalog(spark, sf_dir), FACETS)


def _facet_sql() -> str:
    base = _search_sql("path, directory, extension, language, mime_type, keywords")
    head, body = base.rsplit("\nSELECT path, directory", 1)
    rows = ",\ncatalog AS (SELECT path, directory" + body + "),\nlong AS (" + " UNION ALL ".join(
        [
            "SELECT 'Directory' AS facet, directory AS value FROM catalog",
            "SELECT 'Extension', extension FROM catalog",
            "SELECT 'Language', language FROM catalog",
            "SELECT 'MIME Type', mime_type FROM catalog",
            "SELECT 'Keywords', unnest(string_split(keywords, ' ')) FROM catalog WHERE keywords <> ''",
        ]
    ) + ")"
    return head + rows + """
SELECT facet, value, n FROM (
  SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS rn
  FROM (SELECT facet, value, count(*) AS n FROM long GROUP BY facet, value)) WHERE rn <= 10"""


ORACLES["term_facets"] = _facet_sql()

QUERIES["filter_terms"] = lambda spark, sf_dir: sm.filter_terms(
    sm.filter_terms(_catalog(spark, sf_dir), "language", ["en", "fr"]), "file.extension", [".md", ".txt"]
).select("path", "language")
ORACLES["filter_terms"] = _search_sql(
    "path, language", "language IN ('en', 'fr') AND extension IN ('.md', '.txt')"
)

QUERIES["filter_date_range"] = lambda spark, sf_dir: sm.filter_date_range(
    table(spark, sf_dir, "events"), "ts", "2024-01-02", "2024-01-20"
).select("event_id", "ts")
ORACLES["filter_date_range"] = """SELECT event_id, ts FROM events
WHERE ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-01-20'"""

QUERIES["page_results"] = lambda spark, sf_dir: sm.page_results(
    _file_catalog(spark, sf_dir), [F.desc("file.size_bytes"), "path"], n=20, page=3
).select("path", "file.size_bytes")
ORACLES["page_results"] = with_views(
    "SELECT path, strlen(content) AS size_bytes FROM files ORDER BY size_bytes DESC, path LIMIT 20 OFFSET 40",
    "files",
)

# Facets of fields with very many values: only values of cells that can hold a shown one are counted.
_KEYS = ["l_orderkey", "l_partkey", "l_suppkey"]
QUERIES["term_facets_frequent"] = lambda spark, sf_dir: sm.term_facets(
    table(spark, sf_dir, "lineitem"), _KEYS, size=20, cells=1 << 16
)
ORACLES["term_facets_frequent"] = " UNION ALL ".join(
    f"""SELECT * FROM (SELECT '{k}' AS facet, CAST({k} AS VARCHAR) AS value, count(*) AS n FROM lineitem
WHERE {k} IS NOT NULL GROUP BY {k} ORDER BY n DESC, value LIMIT 20)"""
    for k in _KEYS
)

# A page far from the front: its range is selected by counts, and only the range is sorted.
_PRICED = ["l_extendedprice", "l_shipdate", "l_orderkey", "l_linenumber"]
QUERIES["page_results_deep"] = lambda spark, sf_dir: sm.page_results(
    table(spark, sf_dir, "lineitem").select(*_PRICED), [("l_extendedprice", "desc"), *_PRICED[1:]], n=50, page=100
)
ORACLES["page_results_deep"] = """SELECT l_extendedprice, l_shipdate, l_orderkey, l_linenumber FROM lineitem
ORDER BY l_extendedprice DESC, l_shipdate, l_orderkey, l_linenumber LIMIT 50 OFFSET 4950"""

QUERIES["result_view"] = lambda spark, sf_dir: sm.result_view(_catalog(spark, sf_dir))
ORACLES["result_view"] = _search_sql(
    """filename AS heading, directory, size_bytes AS size, extension, language, line_count,
  CAST(NULL AS VARCHAR) AS complexity, CAST(NULL AS VARCHAR) AS imports, content_preview"""
)

QUERIES["detail_view"] = lambda spark, sf_dir: sm.detail_view(_catalog(spark, sf_dir)).withColumn(
    "keywords", F.array_join("keywords", " ")
)
ORACLES["detail_view"] = _search_sql(
    """filename AS title, content_preview AS description, keywords, mime_type AS file_type,
  CASE WHEN size_bytes >= 1024 THEN printf('%.1f KB', floor(size_bytes / 1024 * 10 + 0.5) / 10) ELSE size_bytes || ' B' END AS size,
  CAST(NULL AS VARCHAR) AS created, CAST(NULL AS VARCHAR) AS modified"""
)

# ---- whole jobs ------------------------------------------------------------------------------------


def catalog_from_files(spark, sf_dir):
    catalog = sm.catalog_from_files(
        sm.files_from_table(view(spark, sf_dir, "files")),
        select={"exclude_globs": ["src1*"], "max_depth": 2},
    )
    return catalog.select(
        "path", "file.filename", "mime_type", F.array_join("profiles", ",").alias("profiles"),
        "line_count", "language", F.array_join("keywords", " ").alias("keywords"), "json_valid",
    )


QUERIES["build_catalog"] = catalog_from_files
ORACLES["build_catalog"] = files_text_sql(
    f"""SELECT f.path, string_split(f.path, '/')[-1] AS filename, {MIME.replace('path', 'f.path')} AS mime_type,
  CASE string_split(f.path, '.')[-1] WHEN 'csv' THEN 'text,tabular' WHEN 'json' THEN 'text,tabular,json'
       WHEN 'py' THEN 'text,python' ELSE 'text' END AS profiles,
  {LINES} AS line_count, coalesce(language, 'unknown') AS language, coalesce(keywords, '') AS keywords,
  CASE WHEN f.path LIKE '%.json' THEN json_valid(content) END AS json_valid
FROM files f LEFT JOIN keywords k ON k.path = f.path LEFT JOIN spoken s ON s.path = f.path
WHERE f.path NOT LIKE '/src1%' AND f.path NOT LIKE '%/.%'"""
)


def _stored_index(spark, sf_dir):
    """An index of all documents, refreshed with the labelled ones; its folder."""
    folder = f"{work_dir(spark)}/{uuid.uuid4().hex}/index"
    catalog = _file_catalog(spark, sf_dir)
    sm.refresh_index(spark, catalog, folder)
    labelled = (
        sm.files_from_table(view(spark, sf_dir, "files"))
        .join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    )
    sm.refresh_index(
        spark, sm.file_identity(labelled).select("path", "file"), folder, visible_to=["reviewers"]
    )
    return folder


QUERIES["refresh_index"] = lambda spark, sf_dir: _flat(sm.read_index(spark, _stored_index(spark, sf_dir)))
ORACLES["refresh_index"] = _entry_sql(
    """SELECT * FROM old_entries WHERE subject NOT IN (SELECT subject FROM new_entries)
UNION ALL SELECT * FROM new_entries WHERE visible_to = 'reviewers'"""
)


def flagship(spark, sf_dir):
    """Select, profile and facet: the smallest whole job."""
    files = sm.files_from_table(view(spark, sf_dir, "files"))
    chosen = sm.select_files(files, exclude_globs=["src0"], max_depth=2)
    catalog = sm.text_profile(sm.file_identity(chosen))
    return sm.term_facets(
        catalog, {"Directory": "file.directory", "Extension": "file.extension", "Language": "language"}
    )


QUERIES["select_profile_facet"] = flagship


def _flagship_sql() -> str:
    base = _search_sql("path, directory, extension, language", "path NOT LIKE '/src0/%' AND path NOT LIKE '%/.%'")
    head, body = base.rsplit("\nSELECT path, directory", 1)
    return head + ",\ncatalog AS (SELECT path, directory" + body + """),
long AS (SELECT 'Directory' AS facet, directory AS value FROM catalog
  UNION ALL SELECT 'Extension', extension FROM catalog UNION ALL SELECT 'Language', language FROM catalog)
SELECT facet, value, n FROM (
  SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS rn
  FROM (SELECT facet, value, count(*) AS n FROM long GROUP BY facet, value)) WHERE rn <= 10"""


ORACLES["select_profile_facet"] = _flagship_sql()
