"""Text, JSON, YAML and tabular profiles."""

from __future__ import annotations

import uuid

import shelfmark as sm
from pyspark.sql import functions as F

from shelfmark.session import work_dir

from .selection_queries import LINES, STOP, WORDS, files_text_sql
from .views import table, view, with_views

QUERIES, ORACLES = {}, {}


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumnRenamed("text", "content")


_DOCUMENTS = "(SELECT doc_id, text AS content FROM documents)"

_TEXT = ["content_preview", "line_count", "word_count", "char_count"]
_TEXT_SQL = {
    "content_preview": "substr(content, 1, 1000)",
    "line_count": LINES,
    "word_count": r"len(regexp_extract_all(content, '[\p{L}\p{N}_]+'))",
    "char_count": "length(content)",
}
for _name in _TEXT:
    QUERIES[_name] = lambda spark, sf_dir, name=_name: sm.text_profile(
        _documents(spark, sf_dir)
    ).select("doc_id", name)
    ORACLES[_name] = f"SELECT doc_id, {_TEXT_SQL[_name]} AS {_name} FROM {_DOCUMENTS}"

QUERIES["detect_language"] = lambda spark, sf_dir: sm.text_profile(
    view(spark, sf_dir, "files")
).select("path", "language")
ORACLES["detect_language"] = files_text_sql(
    "SELECT f.path, coalesce(language, 'unknown') AS language FROM files f LEFT JOIN spoken s ON s.path = f.path"
)

QUERIES["extract_keywords"] = lambda spark, sf_dir: sm.extract_keywords(
    view(spark, sf_dir, "files"), "path"
)
ORACLES["extract_keywords"] = files_text_sql(
    "SELECT path, CAST(rank AS INTEGER) AS rank, word AS keyword FROM ranked WHERE rank <= 10"
)

QUERIES["language_breakdown"] = lambda spark, sf_dir: sm.language_breakdown(
    sm.text_profile(view(spark, sf_dir, "files"))
)
ORACLES["language_breakdown"] = files_text_sql(
    """SELECT coalesce(language, 'unknown') AS language, count(*) AS n
FROM files f LEFT JOIN spoken s ON s.path = f.path GROUP BY 1"""
)

# ---- JSON ------------------------------------------------------------------------------

QUERIES["json_validity"] = lambda spark, sf_dir: sm.json_validity(
    view(spark, sf_dir, "json_rows")
    .select("content")
    .unionByName(table(spark, sf_dir, "events").select(F.col("props").alias("content")))
).select("content", "json_valid", F.col("json_error").isNotNull().alias("has_error"))
ORACLES["json_validity"] = with_views(
    """SELECT content, json_valid(content) AS json_valid, NOT json_valid(content) AS has_error
FROM (SELECT content FROM json_rows UNION ALL SELECT props FROM events)""",
    "json_rows",
)


def json_structure(spark, sf_dir):
    s = F.col("json_structure")
    return sm.json_profile(view(spark, sf_dir, "json_rows")).select(
        "p_partkey",
        s["type"].alias("type"),
        s["key_count"].alias("key_count"),
        F.array_join(s["sample_keys"], ",").alias("sample_keys"),
        s["length"].alias("length"),
        F.array_join(s["sample_item_types"], ",").alias("item_types"),
    )


QUERIES["json_structure"] = json_structure
ORACLES["json_structure"] = with_views(
    """SELECT p_partkey,
  CASE p_partkey % 7 WHEN 0 THEN 'object' WHEN 1 THEN 'array' WHEN 2 THEN 'string'
       WHEN 3 THEN 'number' WHEN 6 THEN 'object' END AS type,
  CASE WHEN valid AND json_type(j) = 'OBJECT' THEN len(json_keys(j)) END AS key_count,
  CASE WHEN valid AND json_type(j) = 'OBJECT' THEN array_to_string(json_keys(j), ',') END AS sample_keys,
  CASE WHEN valid AND json_type(j) = 'ARRAY' THEN CAST(json_array_length(j) AS BIGINT)
       WHEN valid AND json_type(j) = 'VARCHAR' THEN length(j ->> '$') END AS length,
  CASE WHEN p_partkey % 7 = 1 THEN 'array,boolean,null,number,object,string' END AS item_types
FROM (SELECT p_partkey, json_valid(content) AS valid,
             CASE WHEN json_valid(content) THEN CAST(content AS JSON) END AS j FROM json_rows)""",
    "json_rows",
)

QUERIES["json_root_keys"] = lambda spark, sf_dir: sm.json_profile(
    view(spark, sf_dir, "json_rows")
    .select("content")
    .unionByName(table(spark, sf_dir, "events").select(F.col("props").alias("content")))
).select("content", F.array_join("json_root_keys", ",").alias("keys"), "json_root_key_count")
ORACLES["json_root_keys"] = with_views(
    """SELECT content,
  CASE WHEN json_valid(content) THEN array_to_string(coalesce(json_keys(content), []), ',') END AS keys,
  CASE WHEN json_valid(content) THEN len(coalesce(json_keys(content), [])) END AS json_root_key_count
FROM (SELECT content FROM json_rows UNION ALL SELECT props FROM events)""",
    "json_rows",
)

QUERIES["json_depth"] = lambda spark, sf_dir: sm.json_profile(
    view(spark, sf_dir, "json_rows")
).select("p_partkey", "json_depth")
ORACLES["json_depth"] = with_views(
    """SELECT p_partkey, CAST(CASE p_partkey % 7 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 0 WHEN 3 THEN 0
       WHEN 6 THEN 2 END AS BIGINT) AS json_depth FROM json_rows""",
    "json_rows",
)

QUERIES["json_size"] = lambda spark, sf_dir: sm.json_profile(
    table(spark, sf_dir, "events").withColumnRenamed("props", "content")
).select("event_id", "json_size", "json_depth")
ORACLES["json_size"] = (
    "SELECT event_id, length(props) AS json_size, CAST(1 AS BIGINT) AS json_depth FROM events"
)

QUERIES["key_frequency"] = lambda spark, sf_dir: sm.key_frequency(
    view(spark, sf_dir, "json_rows")
    .select("content")
    .unionByName(table(spark, sf_dir, "events").select(F.col("props").alias("content")))
)
ORACLES["key_frequency"] = with_views(
    """SELECT key, count(*) AS n FROM (
  SELECT unnest(json_keys(content)) AS key
  FROM (SELECT content FROM json_rows UNION ALL SELECT props FROM events)
  WHERE json_valid(content)) GROUP BY key""",
    "json_rows",
)


def yaml_profile(spark, sf_dir):
    s = F.col("yaml_structure")
    return sm.yaml_profile(view(spark, sf_dir, "yaml_rows")).select(
        "p_partkey", "yaml_valid", F.col("yaml_error").isNotNull().alias("has_error"),
        s["type"].alias("type"), s["length"].alias("length"),
        F.array_join(s["sample_item_types"], ",").alias("item_types"),
        F.array_join("yaml_root_keys", ",").alias("keys"),
        "yaml_root_key_count", "yaml_depth", "yaml_size",
    )


QUERIES["yaml_profile"] = yaml_profile
ORACLES["yaml_profile"] = with_views(
    """SELECT p_partkey, p_partkey % 5 < 3 AS yaml_valid, p_partkey % 5 >= 3 AS has_error,
  CASE p_partkey % 5 WHEN 0 THEN 'mapping' WHEN 1 THEN 'sequence' WHEN 2 THEN 'string' END AS type,
  CAST(CASE p_partkey % 5 WHEN 1 THEN 4 WHEN 2 THEN length(content) END AS BIGINT) AS length,
  CASE p_partkey % 5 WHEN 1 THEN 'boolean,date,mapping,number' END AS item_types,
  CASE p_partkey % 5 WHEN 0 THEN 'id,brand,dims,made' WHEN 1 THEN '' WHEN 2 THEN '' END AS keys,
  CAST(CASE p_partkey % 5 WHEN 0 THEN 4 WHEN 1 THEN 0 WHEN 2 THEN 0 END AS BIGINT) AS yaml_root_key_count,
  CAST(CASE p_partkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 0 END AS BIGINT) AS yaml_depth,
  CASE WHEN p_partkey % 5 < 3 THEN length(content) END AS yaml_size
FROM yaml_rows""",
    "yaml_rows",
)

# ---- tables ------------------------------------------------------------------------------


def table_shape(spark, sf_dir):
    shapes = [
        sm.table_shape(table(spark, sf_dir, t)).select(
            F.lit(t).alias("table"), "column_count", "row_count",
            F.array_join("columns", ",").alias("columns"),
        )
        for t in ("part", "orders")
    ]
    return shapes[0].unionByName(shapes[1])


QUERIES["table_shape"] = table_shape
ORACLES["table_shape"] = """SELECT 'part' AS "table", CAST(6 AS BIGINT) AS column_count, count(*) AS row_count,
  'p_partkey,p_name,p_brand,p_type,p_size,p_retailprice' AS columns FROM part
UNION ALL
SELECT 'orders', 6, count(*),
  'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' FROM orders"""


def _detect(view_name: str, column: str) -> str:
    return f"""SELECT '{view_name}' AS "table", '{column}' AS "column",
  CASE WHEN n = 0 THEN 'empty'
       WHEN n_number = n THEN CASE WHEN n_integral = n THEN 'integer' ELSE 'float' END
       WHEN n_date = n THEN 'date' WHEN n_flag = n THEN 'boolean' ELSE 'string' END AS column_type
FROM (SELECT count(v) AS n, count(TRY_CAST(v AS DOUBLE)) AS n_number,
        count(*) FILTER (TRY_CAST(v AS DOUBLE) = floor(TRY_CAST(v AS DOUBLE))) AS n_integral,
        count(*) FILTER (regexp_matches(v, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) AS n_date,
        count(*) FILTER (lower(v) IN ('true','false','yes','no','1','0','t','f','y','n')) AS n_flag
      FROM (SELECT nullif(CAST({column} AS VARCHAR), '') AS v FROM {view_name}))"""


_TYPED = {
    "part_text": [
        "key_text", "size_text", "price_text", "flag_text", "name_text", "blank_text", "bit_text",
        "size_number", "price_number",
    ],
    "order_text": ["key_text", "status_text", "date_text", "priority_text", "date_value"],
}


def infer_column_types(spark, sf_dir):
    found = [
        sm.infer_column_types(view(spark, sf_dir, v)).withColumn("table", F.lit(v)) for v in _TYPED
    ]
    return found[0].unionByName(found[1])


QUERIES["infer_column_types"] = infer_column_types
ORACLES["infer_column_types"] = with_views(
    "\nUNION ALL\n".join(_detect(v, c) for v, columns in _TYPED.items() for c in columns), *_TYPED
)


def _statistics(source: str, column: str) -> str:
    return f"""SELECT '{column}' AS "column", count(*) AS "count", count(*) - count(v) AS null_count,
  min(x) AS "min", max(x) AS "max", round(avg(x), 4) AS mean, round(median(x), 4) AS median
FROM (SELECT v, TRY_CAST(v AS DOUBLE) AS x
      FROM (SELECT nullif(CAST({column} AS VARCHAR), '') AS v FROM {source}))"""


def _rounded(profile):
    return profile.withColumns(
        {"mean": F.round("mean", 4), "median": F.round("median", 4)}
    )


_LINEITEM = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]

QUERIES["column_statistics"] = lambda spark, sf_dir: _rounded(
    sm.column_statistics(table(spark, sf_dir, "lineitem"))
)
ORACLES["column_statistics"] = "\nUNION ALL\n".join(_statistics("lineitem", c) for c in _LINEITEM)


QUERIES["profile_table"] = lambda spark, sf_dir: _rounded(
    sm.profile_table(view(spark, sf_dir, "part_text"))
)
ORACLES["profile_table"] = with_views(
    "\nUNION ALL\n".join(
        f"SELECT s.*, t.column_type FROM ({_statistics('part_text', c)}) s, ({_detect('part_text', c)}) t"
        for c in _TYPED["part_text"]
    ),
    "part_text",
)


def profile_delimited_files(spark, sf_dir):
    """The parts of a brand, 500 keys at a time, as small delimited files held in a column."""
    from shelfmark.operators.tabular import file_cells, profile_files

    rows = table(spark, sf_dir, "part").select(
        "p_brand", F.floor(F.col("p_partkey") / 500).alias("chunk"),
        F.concat_ws(",", "p_partkey", "p_size", F.concat(F.lit('"'), "p_name", F.lit(', x"'))).alias("line")
    )
    files = rows.groupBy("p_brand", "chunk").agg(
        F.concat(F.lit("key,size,name\n"), F.array_join(F.collect_list("line"), "\n")).alias("content")
    ).select(F.concat(F.lit("/"), "p_brand", F.lit("/"), "chunk", F.lit(".csv")).alias("path"), "content")
    profiled = profile_files(file_cells(files))
    size = F.col("sample_statistics")["size"]
    return profiled.select(
        "path", "column_count", "line_count", "row_count", F.array_join("columns", ",").alias("columns"),
        F.col("column_types")["key"].alias("key_type"), F.col("column_types")["name"].alias("name_type"),
        size["min"].alias("min_size"), size["max"].alias("max_size"), size["median"].alias("median_size"),
    )


QUERIES["profile_delimited_files"] = profile_delimited_files
ORACLES["profile_delimited_files"] = """SELECT '/' || p_brand || '/' || p_partkey // 500 || '.csv' AS path, CAST(3 AS BIGINT) AS column_count,
  count(*) + 1 AS line_count, count(*) AS row_count, 'key,size,name' AS columns,
  'integer' AS key_type, 'string' AS name_type, CAST(min(p_size) AS DOUBLE) AS min_size,
  CAST(max(p_size) AS DOUBLE) AS max_size, CAST(median(p_size) AS DOUBLE) AS median_size
FROM part GROUP BY p_brand, p_partkey // 500"""


def read_delimited_quoted(spark, sf_dir):
    """All documents, whose texts have line ends and quotes, written as delimited files and read back."""
    folder = f"{work_dir(spark)}/{uuid.uuid4().hex}/documents.csv"
    table(spark, sf_dir, "documents").select("doc_id", "source", "text").write.options(
        header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(folder)
    rows = sm.read_delimited(spark, folder, multi_line=True)
    text = F.coalesce("text", F.lit(""))
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", F.length(text).cast("long").alias("n_chars"),
        F.md5(text).alias("text_md5"),
    )


QUERIES["read_delimited_quoted"] = read_delimited_quoted
ORACLES["read_delimited_quoted"] = r"""SELECT doc_id, source, length(t) AS n_chars, md5(t) AS text_md5
FROM (SELECT *, replace(coalesce(text, ''), chr(13) || chr(10), chr(10)) AS t FROM documents)"""
