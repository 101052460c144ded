"""Source-code profile: symbols, imports, complexity and comments of Python modules.

A helper parses each module and hands back its plain facts (definitions, imports, node
counts); visibility, import classes, complexity and all roll-ups are column expressions
and aggregations.
"""

from __future__ import annotations

import ast
from collections import Counter
from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import BRANCH_KINDS, STANDARD_LIBRARY_MODULES, STATEMENT_KINDS
from ..functions.arrow import map_texts
from ..functions.text import char_count, line_count
from ..session import wide

PARAMETER = "struct<name string, annotation string>"
SYMBOL = (
    "struct<kind string, name string, parent string, line bigint, end_line bigint, "
    f"bases array<string>, parameters array<{PARAMETER}>, returns string, "
    "annotation string, value_type string, docstring string>"
)
IMPORT = "struct<module string, level int, names array<string>>"
FACTS = {
    "module_docstring": "string",
    "symbols": f"array<{SYMBOL}>",
    "imports": f"array<{IMPORT}>",
    "kinds": "map<string, bigint>",
}


def _expression_name(node: ast.expr) -> str:
    """Short text of an expression: dotted names in full, the rest abbreviated."""
    tail = ""
    while True:
        match node:
            case ast.Name(id=name):
                return name + tail
            case ast.Attribute(value=inner, attr=attr):
                node, tail = inner, f".{attr}{tail}"
            case ast.Subscript(value=inner):
                node, tail = inner, f"[...]{tail}"
            case ast.Call(func=inner):
                node, tail = inner, f"(...){tail}"
            case ast.Constant(value=value):
                return f"{value}{tail}"
            case _:
                return f"...{tail}"


def _value_type(node: ast.expr) -> str:
    match node:
        case ast.Constant(value=None):
            return "None"
        case ast.Constant(value=bool()):
            return "bool"
        case ast.Constant(value=str()):
            return "str"
        case ast.Constant(value=int() | float() | complex()):
            return "num"
        case ast.List() | ast.Dict() | ast.Tuple() | ast.Set():
            return type(node).__name__.lower()
    return "unknown"


def _definition(kind: str, node, parent: str | None = None) -> dict:
    row = {
        "kind": kind,
        "name": node.name,
        "parent": parent,
        "line": node.lineno,
        "end_line": node.end_lineno,
        "docstring": ast.get_docstring(node) or None,
    }
    if kind == "class":
        row["bases"] = [_expression_name(base) for base in node.bases]
    else:
        row["parameters"] = [
            {"name": a.arg, "annotation": a.annotation and _expression_name(a.annotation)}
            for a in node.args.args
        ]
        row["returns"] = node.returns and _expression_name(node.returns)
    return row


def _symbols(tree: ast.Module) -> list[dict]:
    function = (ast.FunctionDef, ast.AsyncFunctionDef)
    rows = []
    for node in tree.body:
        if isinstance(node, ast.ClassDef):
            rows.append(_definition("class", node))
            rows += [_definition("method", m, node.name) for m in node.body if isinstance(m, function)]
        elif isinstance(node, function):
            rows.append(_definition("function", node))
        elif isinstance(node, ast.Assign):
            rows += [
                {"kind": "variable", "name": t.id, "line": node.lineno,
                 "value_type": _value_type(node.value)}
                for t in node.targets if isinstance(t, ast.Name)
            ]
        elif isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name):
            rows.append(
                {"kind": "variable", "name": node.target.id, "line": node.lineno,
                 "annotation": _expression_name(node.annotation)}
            )
    return rows


def _module_facts(text: str, parts: Sequence[str]) -> dict:
    try:
        tree = ast.parse(text)
        nodes = list(ast.walk(tree))
        imports = []
        for node in nodes:
            if isinstance(node, ast.Import):
                imports += [{"module": a.name, "level": 0} for a in node.names]
            elif isinstance(node, ast.ImportFrom) and node.module:
                imports.append(
                    {"module": node.module, "level": node.level,
                     "names": [a.name for a in node.names]}
                )
        # Symbols are made even where they are not asked for: a module where that fails has no facts.
        facts = {"module_docstring": ast.get_docstring(tree) or None, "symbols": _symbols(tree), "imports": imports}
        if "kinds" in parts:
            facts["kinds"] = [(kind.__name__, n) for kind, n in Counter(map(type, nodes)).items()]
        return {name: fact for name, fact in facts.items() if name in parts}
    except SyntaxError as problem:
        return {"error": f"Syntax error: {problem}"}
    except Exception as problem:  # e.g. NUL characters, or nesting beyond the parser
        return {"error": f"{type(problem).__name__}: {problem}"}


def module_facts(content: Column, parts: Sequence[str] = tuple(FACTS)) -> Column:
    """The plain facts of a module text as one struct (null for null): ``error`` and the ``parts``."""
    fields = ", ".join(f"{name} {FACTS[name]}" for name in parts)
    return map_texts(content, partial(_module_facts, parts=tuple(parts)), f"struct<error string, {fields}>")


def comment_lines(content: Column) -> Column:
    """Lines whose first visible character is ``#``."""
    is_comment = lambda line: line.rlike(r"^\s*#")
    return F.size(F.filter(F.split(content, "\n", -1), is_comment)).cast("long")


def comment_ratio(content: Column) -> Column:
    return F.bround(comment_lines(content) / line_count(content), 2)


def comment_stats(df: DataFrame, content: str = "content") -> DataFrame:
    """Add ``comment_lines`` and ``comment_ratio`` (to all lines, two decimals)."""
    text = F.col(content)
    return df.withColumns(
        {"comment_lines": comment_lines(text), "comment_ratio": comment_ratio(text)}
    )


def visibility(kind: Column, name: Column) -> Column:
    """special (dunder methods), private or public; null for classes and variables."""
    private = F.startswith(name, F.lit("_"))
    dunder = F.startswith(name, F.lit("__")) & F.endswith(name, F.lit("__"))
    return F.when(
        kind.isin("method", "function"),
        F.when((kind == "method") & dunder, F.lit("special"))
        .when(private, F.lit("private"))
        .otherwise(F.lit("public")),
    )


def import_class(module: Column, level: Column, local_prefixes: Sequence[str] = ()) -> Column:
    """standard_library / third_party / local; a project names its own prefixes."""
    top = F.substring_index(module, ".", 1)
    own = F.lit(False)
    for prefix in local_prefixes:
        own = own | F.startswith(top, F.lit(prefix))
    return (
        F.when(level > 0, F.lit("local"))
        .when(top.isin(STANDARD_LIBRARY_MODULES), F.lit("standard_library"))
        .when(own, F.lit("local"))
        .otherwise(F.lit("third_party"))
    )


def import_text(item: Column) -> Column:
    """``module`` or ``module -> names``, with a dot per level of a relative import."""
    dotted = F.concat(F.repeat(F.lit("."), item["level"]), item["module"])
    return F.when(item["names"].isNull(), dotted).otherwise(
        F.concat(dotted, F.lit(" -> "), F.array_join(item["names"], ", "))
    )


def complexity(kinds: Column) -> Column:
    """Statement and branch counts from a map of node counts."""
    count = lambda kind: F.coalesce(F.try_element_at(kinds, F.lit(kind)), F.lit(0))
    total = lambda names: sum((count(n) for n in names), F.lit(0)).cast("long")
    branches = [count(kind).cast("long").alias(name) for name, kind in BRANCH_KINDS.items()]
    return F.struct(
        total(STATEMENT_KINDS).alias("statement_count"),
        F.struct(*branches).alias("control_flow"),
        (total(BRANCH_KINDS.values()) + 1).alias("cyclomatic_complexity"),
    )


def code_struct(content: Column, facts: Column, local_prefixes: Sequence[str] = ()) -> Column:
    """The record of one module: nested symbols, grouped imports and complexity."""
    of_kind = lambda kind: F.filter(facts["symbols"], lambda s: s["kind"] == kind)

    def imports_of(name: str) -> Column:
        mine = F.filter(
            facts["imports"],
            lambda i: import_class(i["module"], i["level"], local_prefixes) == name,
        )
        return F.transform(mine, import_text)

    counted = complexity(facts["kinds"])
    parsed = facts.isNotNull() & facts["error"].isNull()
    classes = ("standard_library", "third_party", "local")
    return F.struct(
        line_count(content).alias("line_count"),
        char_count(content).alias("char_count"),
        facts["module_docstring"].alias("module_docstring"),
        F.when(parsed, F.struct(*[imports_of(n).alias(n) for n in classes])).alias("imports"),
        of_kind("class").alias("classes"),
        of_kind("method").alias("methods"),
        of_kind("function").alias("functions"),
        of_kind("variable").alias("variables"),
        F.when(
            parsed,
            F.struct(
                counted["statement_count"].alias("statement_count"),
                counted["control_flow"].alias("control_flow"),
                counted["cyclomatic_complexity"].alias("cyclomatic_complexity"),
                comment_lines(content).alias("comment_lines"),
                comment_ratio(content).alias("comment_ratio"),
            ),
        ).alias("complexity"),
        facts["error"].alias("error"),
    )


def code_facts(df: DataFrame, content: str = "content") -> DataFrame:
    """Add ``facts``; select from it with the functions below."""
    return df.withColumn("facts", module_facts(F.col(content)))


def _dealt_facts(df: DataFrame, key: str, content: str, part: str) -> DataFrame:
    """The key and one part of ``facts``. Parsing is dear for the size of a text, and a small
    file is read by one task, so the texts are dealt over all tasks first."""
    texts = df.select(F.col(key).alias("__key"), F.col(content).alias("__content"))
    dealt = texts.repartition(wide(df.sparkSession), "__key", "__content")
    return dealt.select(F.col("__key").alias(key), module_facts(F.col("__content"), [part]).alias("facts"))


def code_symbols(df: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """One row per class, method, function and global variable."""
    # The outer form here and below: the plain one lets Spark derive a filter on the parsed
    # array and evaluate the parser a second time for it.
    rows = _dealt_facts(df, key, content, "symbols").select(key, F.inline_outer("facts.symbols"))
    return rows.where(F.col("kind").isNotNull()).withColumn("visibility", visibility(F.col("kind"), F.col("name")))


def code_imports(
    df: DataFrame,
    key: str = "path",
    content: str = "content",
    local_prefixes: Sequence[str] = (),
) -> DataFrame:
    """One row per import with its class and display text."""
    rows = _dealt_facts(df, key, content, "imports").select(key, F.explode_outer("facts.imports").alias("item"))
    return rows.where(F.col("item").isNotNull()).select(
        key,
        F.col("item.module").alias("module"),
        F.col("item.level").alias("level"),
        F.col("item.names").alias("names"),
        import_class(F.col("item.module"), F.col("item.level"), local_prefixes).alias("class"),
        import_text(F.col("item")).alias("text"),
    )


def import_frequency(imports: DataFrame, k: int | None = None) -> DataFrame:
    """Most used modules over a corpus; ``k`` makes it a top-k report."""
    counted = imports.groupBy("module").agg(F.count("*").alias("n"))
    return counted if k is None else counted.orderBy(F.desc("n"), "module").limit(k)


def code_complexity(df: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """Statement count, branch counts and ``1 + branches`` per module that parses."""
    parsed = _dealt_facts(df, key, content, "kinds").select(
        key, F.explode_outer(F.array("facts.kinds")).alias("kinds")
    )
    return parsed.where(F.col("kinds").isNotNull()).select(key, complexity(F.col("kinds")).alias("c")).select(
        key,
        F.col("c.statement_count").alias("statement_count"),
        *[F.col(f"c.control_flow.{n}").alias(f"n_{n}") for n in BRANCH_KINDS],
        F.col("c.cyclomatic_complexity").alias("cyclomatic_complexity"),
    )
