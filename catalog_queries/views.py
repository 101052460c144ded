"""The derived views of the queries: one SQL text serves Spark and the oracle alike."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    # Documents as files: /source[/.cache]/lang/doc_<id><suffix>.
    "files": (
        "documents",
        """SELECT doc_id,
       '/' || source || '/' || CASE WHEN doc_id % 17 = 0 THEN '.cache/' ELSE '' END || lang
           || '/doc_' || doc_id
           || CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.md' WHEN 2 THEN '.csv'
                              WHEN 3 THEN '.json' ELSE '.py' END AS path,
       text AS content
FROM documents""",
    ),
    # Web pages as files: page number and URL without scheme, query and fragment.
    "page_files": (
        "pages",
        """SELECT page_id,
       '/page_' || page_id || '/'
           || regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path,
       html AS content
FROM pages""",
    ),
    # Parts as files with many kinds of suffix.
    "part_files": (
        "part",
        """SELECT p_partkey,
       '/parts/' || p_brand || '/' || CASE p_partkey % 9 WHEN 8 THEN '.part_' ELSE 'part_' END
           || p_partkey
           || CASE p_partkey % 9 WHEN 0 THEN '.tar.gz' WHEN 1 THEN '.tgz' WHEN 2 THEN '.CSV'
                WHEN 3 THEN '.png' WHEN 4 THEN '.PDF' WHEN 5 THEN '.unknown'
                WHEN 6 THEN '' WHEN 7 THEN '.json.bz2' ELSE '' END AS path,
       CAST(p_size AS BIGINT) AS size_bytes
FROM part""",
    ),
    # JSON texts of every shape, some of them broken.
    "json_rows": (
        "part",
        """SELECT p_partkey,
       CASE p_partkey % 7
         WHEN 0 THEN '{"id": ' || p_partkey || ', "brand": "' || p_brand
                     || '", "dims": {"size": ' || p_size || ', "tags": ["a", "b}"]}, "none": null}'
         WHEN 1 THEN '[' || p_partkey || ', true, "' || p_name || '", {"k": [' || p_size || ']}, [], null]'
         WHEN 2 THEN '"' || p_name || '"'
         WHEN 3 THEN '' || p_partkey
         WHEN 4 THEN '{"id": ' || p_partkey || '} trailing'
         WHEN 5 THEN '{"broken": ' || p_partkey
         ELSE '{"id": ' || p_partkey || ', "x": {}, "y": [], "z": [[]], "a": 1, "b": 2}'
       END AS content
FROM part""",
    ),
    # Text columns with blanks.
    "part_text": (
        "part",
        """SELECT CASE WHEN p_partkey % 13 = 0 THEN '' ELSE CAST(p_partkey AS VARCHAR(20)) END AS key_text,
       CASE WHEN p_partkey % 13 = 1 THEN NULL ELSE CAST(p_size AS VARCHAR(20)) END AS size_text,
       CASE WHEN p_partkey % 13 = 2 THEN '' ELSE p_retailprice || '' END AS price_text,
       CASE WHEN p_partkey % 13 = 3 THEN '' WHEN p_size % 2 = 0 THEN 'yes' ELSE 'No' END AS flag_text,
       p_name AS name_text,
       CASE WHEN p_partkey % 2 = 0 THEN '' ELSE NULL END AS blank_text,
       CASE WHEN p_partkey % 3 = 0 THEN '1' ELSE '0' END AS bit_text,
       p_size AS size_number, p_retailprice AS price_number
FROM part""",
    ),
    "order_text": (
        "orders",
        """SELECT CAST(o_orderkey AS VARCHAR(20)) AS key_text, o_orderstatus AS status_text,
       CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE CAST(o_orderdate AS VARCHAR(30)) END AS date_text,
       o_orderpriority AS priority_text, o_orderdate AS date_value
FROM orders""",
    ),
    # Line items as pixels of images.
    "pixels": (
        "lineitem",
        """SELECT l_suppkey AS image_id, CAST(l_orderkey % 4 * 64 AS INT) AS r,
       CAST(l_partkey % 4 * 64 AS INT) AS g, CAST(l_linenumber % 4 * 64 AS INT) AS b
FROM lineitem""",
    ),
    # YAML texts, some of them broken.
    "yaml_rows": (
        "part",
        """SELECT p_partkey,
       CASE p_partkey % 5
         WHEN 0 THEN 'id: ' || p_partkey || '
brand: "' || p_brand || '"
dims:
  size: ' || p_size || '
  tags: [a, b]
made: 2020-01-01
'
         WHEN 1 THEN '- ' || p_size || '
- {k: [1]}
- 2020-01-01
- true
'
         WHEN 2 THEN 'just ' || p_name
         WHEN 3 THEN 'a: [' || p_partkey
         ELSE '---
a: ' || p_size || '
---
b: 1
'
       END AS content
FROM part""",
    ),
    # Python modules, some of them broken.
    "modules": (
        "part",
        """SELECT '/src/mod_' || p_partkey || '.py' AS path, p_partkey, p_size, p_type, p_name,
       CASE WHEN p_partkey % 11 = 0 THEN 'def broken(:
' ELSE '"doc ' || p_partkey || '"
import os.path
import ' || lower(p_type) || '.core as core
from ..pkg import a, b
# note ' || p_name || '
LIMIT = ' || p_size || '

class P' || p_partkey || '(core.Base):
    def __init__(self, x: int):
        self.x = x

    def _hidden(self):
        # never
        return None

async def run(n):
    for i in range(n):
        if i:
            pass
    while n:
        n = 0
' END AS content
FROM part""",
    ),
    # Camera tags and positions.
    "camera": (
        "part",
        """SELECT p_partkey, p_brand AS make, p_type AS model, '1/' || p_size AS exposure,
       p_size || '/10' AS f_number, '' || (p_size * 100) AS iso, p_size || '/1' AS focal,
       CAST(p_partkey % 90 AS DOUBLE) AS deg, CAST(p_size AS DOUBLE) AS mins,
       CAST(p_partkey % 60 AS DOUBLE) AS secs,
       CASE p_partkey % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'S' WHEN 2 THEN 'E' ELSE 'W' END AS hemisphere,
       p_partkey % 2 AS altitude_ref
FROM part""",
    ),
    "compact_dates": (
        "orders",
        """SELECT o_orderkey,
       CASE o_orderkey % 5
         WHEN 0 THEN 'D:' || replace(substring(CAST(o_orderdate AS VARCHAR(30)), 1, 10), '-', '') || '123456+02'
         WHEN 1 THEN replace(substring(CAST(o_orderdate AS VARCHAR(30)), 1, 10), '-', '') || '010203'
         WHEN 2 THEN 'D:' || replace(substring(CAST(o_orderdate AS VARCHAR(30)), 1, 10), '-', '')
         WHEN 3 THEN 'D:20201399000000'
         ELSE 'not a date at all' END AS stamp
FROM orders""",
    ),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame over the given tables."""
    source, sql = VIEWS[name]
    temp = f"{source}_{hashlib.md5(sf_dir.encode()).hexdigest()[:8]}"
    table(spark, sf_dir, source).createOrReplaceTempView(temp)
    return spark.sql(sql.replace(f"FROM {source}", f"FROM {temp}"))


def with_views(sql: str, *names: str) -> str:
    """The oracle text with the views it needs in front."""
    parts = [f"{name} AS ({VIEWS[name][1]})" for name in names]
    return "WITH " + ",\n".join(parts) + "\n" + sql
