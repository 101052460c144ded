"""Choose files by path: globs, regular expressions, dot names and depth.

Every operator is one predicate over the path column, evaluated in the scan stage.
Exclusion applies to a file and to every directory between it and the root, so an
excluded directory takes its whole subtree with it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _excluded_by_glob(path: Column, patterns: Sequence[str], root: str) -> Column:
    return _any([paths.glob_matches(path, p, root, ancestors=True) for p in patterns])


def _excluded_by_regex(path: Column, patterns: Sequence[str], root: str) -> Column:
    return F.exists(
        paths.self_and_ancestors(path, root),
        lambda step: _any([paths.below_root(step, root).rlike(p) for p in patterns]),
    )


def _included(path: Column, globs: Sequence[str], regexes: Sequence[str], root: str) -> Column:
    tests = [paths.glob_matches(path, g, root) for g in globs]
    tests += [paths.below_root(path, root).rlike(r) for r in regexes]
    return _any(tests)


def _is_dot_path(path: Column, root: str) -> Column:
    return paths.below_root(path, root).rlike(paths.DOT_SEGMENT)


def exclude_glob(files: DataFrame, patterns: Sequence[str], root: str = "/") -> DataFrame:
    """Drop files that match a glob, or lie below a directory that does."""
    if not patterns:
        return files
    return files.where(~_excluded_by_glob(F.col("path"), patterns, root))


def exclude_regex(files: DataFrame, patterns: Sequence[str], root: str = "/") -> DataFrame:
    """Drop files whose path below the root, or that of a directory on the way, contains a
    match of an expression."""
    if not patterns:
        return files
    return files.where(~_excluded_by_regex(F.col("path"), patterns, root))


def include_paths(
    files: DataFrame,
    globs: Sequence[str] = (),
    regexes: Sequence[str] = (),
    root: str = "/",
    strict_compat: bool = False,
) -> DataFrame:
    """Keep files that match any glob or any expression.

    A side that is not given is absent. With ``strict_compat`` it matches everything
    instead, so that giving only one side filters nothing.
    """
    if not globs and not regexes:
        return files
    if strict_compat and not (globs and regexes):
        return files
    return files.where(_included(F.col("path"), globs, regexes, root))


def exclude_dot_paths(files: DataFrame, root: str = "/") -> DataFrame:
    """Drop files and directories below the root whose name starts with a dot."""
    return files.where(~_is_dot_path(F.col("path"), root))


def limit_depth(files: DataFrame, max_depth: int, root: str = "/") -> DataFrame:
    """Keep files at most ``max_depth`` directories below the root (whose own files are 0)."""
    return files.where(paths.depth(F.col("path"), root) <= max_depth)


def select_files(
    files: DataFrame,
    root: str = "/",
    exclude_globs: Sequence[str] = (),
    exclude_regexes: Sequence[str] = (),
    include_globs: Sequence[str] = (),
    include_regexes: Sequence[str] = (),
    max_depth: int | None = None,
    ignore_dot_paths: bool = True,
    strict_compat: bool = False,
) -> DataFrame:
    """All path rules as one predicate; the cheap tests come first."""
    path = F.col("path")
    tests: list[Column] = []
    if max_depth is not None:
        tests.append(paths.depth(path, root) <= max_depth)
    if ignore_dot_paths:
        tests.append(~_is_dot_path(path, root))
    given = (bool(include_globs), bool(include_regexes))
    if any(given) and not (strict_compat and not all(given)):
        tests.append(_included(path, include_globs, include_regexes, root))
    if exclude_globs:
        tests.append(~_excluded_by_glob(path, exclude_globs, root))
    if exclude_regexes:
        tests.append(~_excluded_by_regex(path, exclude_regexes, root))
    return files.where(reduce(lambda a, b: a & b, tests)) if tests else files
