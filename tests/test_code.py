"""Source-code profile on hand-built modules."""

import shelfmark as sm
from pyspark.sql import functions as F
from shelfmark.operators.code import module_facts

MODULE = '''"""Doc."""
import os, numpy.linalg as la
from . import sibling
from .pkg import a, b
from typing import List
import mine.core

X: int = 1
Y = Z = "s"
N = None; T = True; L = []; C = 1.5; F_ = f()


class A(B, c.D[int], make()):
    """About A."""

    def __init__(self, a: int, b: List[int] = ()):
        pass

    def _p(self):
        # comment
        return 1

    async def go(self) -> x.Y:
        pass


def top(q):
    for i in q:
        if i:
            while i:
                try:
                    pass
                except E:
                    raise


async def _later():
    pass
'''


def frame(rows):
    return rows([("m", MODULE), ("bad", "def ("), ("nul", "a\x00"), ("none", None)], "path string, content string")


def test_symbols(rows):
    got = {(r["kind"], r["name"]): r for r in sm.code_symbols(frame(rows)).collect()}
    assert {k for k in got if k[0] != "variable"} == {
        ("class", "A"), ("method", "__init__"), ("method", "_p"), ("method", "go"), ("function", "top"), ("function", "_later"),
    }
    assert got["class", "A"]["bases"] == ["B", "c.D[...]", "make(...)"] and got["class", "A"]["docstring"] == "About A."
    assert [got["method", n]["visibility"] for n in ("__init__", "_p", "go")] == ["special", "private", "public"]
    assert got["function", "_later"]["visibility"] == "private" and got["method", "go"]["returns"] == "x.Y"
    parameters = [(p["name"], p["annotation"]) for p in got["method", "__init__"]["parameters"]]
    assert parameters == [("self", None), ("a", "int"), ("b", "List[...]")]
    types = {n: r["value_type"] for (k, n), r in got.items() if k == "variable"}
    assert types == dict(X=None, Y="str", Z="str", N="None", T="bool", L="list", C="num", F_="unknown")
    assert got["variable", "X"]["annotation"] == "int"


def test_imports(rows):
    got = [(r["text"], r["class"]) for r in sm.code_imports(frame(rows), local_prefixes=["mine"]).collect()]
    assert got == [
        ("os", "standard_library"), ("numpy.linalg", "third_party"), (".pkg -> a, b", "local"),
        ("typing -> List", "standard_library"), ("mine.core", "local"),
    ]


def test_complexity_and_comments(rows):
    got = sm.code_complexity(frame(rows)).collect()
    assert len(got) == 1
    assert (got[0]["n_if"], got[0]["n_for"], got[0]["n_while"], got[0]["n_try"], got[0]["cyclomatic_complexity"]) == (1, 1, 1, 1, 5)
    comments = sm.comment_stats(rows([("m", "# a\nx = 1  # b\n\t# c\n")], "path string, content string")).head()
    assert (comments["comment_lines"], comments["comment_ratio"]) == (2, 0.5)


def test_errors_are_reported_per_profile(rows):
    files = rows(
        [("/a.py", "def ("), ("/b.py", "x = 1"), ("/c.json", "{"), ("/d.yml", "a: ["), ("/e.txt", "fine")],
        "path string, content string",
    )
    catalog = sm.catalog_from_files(sm.files_from_table(files), keep_profiles=True, tabular=False)
    errors = {(r["path"], r["profile"]) for r in sm.catalog_errors(catalog).collect()}
    assert errors == {("/a.py", "python"), ("/c.json", "json"), ("/d.yml", "yaml")}
    record = {r["path"]: r for r in catalog.collect()}
    assert record["/a.py"]["word_count"] == 1  # the other profiles survive
    assert record["/b.py"]["complexity"]["statement_count"] == 1


def test_modules_of_one_partition_are_parsed_by_many_tasks(spark, rows):
    """A small file is read by one task, which used to parse all of it."""
    texts = [(f"m{i}", f"import a{i}\nx = {i}\n") for i in range(400)]
    modules = rows(texts, "path string, content string").coalesce(1)
    for found, n in ((sm.code_imports(modules), 400), (sm.code_symbols(modules), 400), (sm.code_complexity(modules), 400)):
        per_task = found.groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert sum(r["count"] for r in per_task) == n
        assert len(per_task) > 8 and max(r["count"] for r in per_task) < n / 4


def test_facts_that_are_not_asked_for_are_left_out(rows):
    for part in ("symbols", "imports", "kinds"):
        facts = frame(rows).select("path", module_facts(F.col("content"), [part]).alias("f"))
        assert facts.schema["f"].dataType.fieldNames() == ["error", part]
        whole = frame(rows).select("path", module_facts(F.col("content")).alias("f"))
        few = sorted(map(str, facts.select("path", "f.error", f"f.{part}").collect()))
        assert few == sorted(map(str, whole.select("path", "f.error", f"f.{part}").collect()))
