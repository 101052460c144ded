"""Path rules against the standard library's own path matching."""

import re
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

import shelfmark as sm
from shelfmark.functions import paths as pf

ROOT = "/data/.store/src"
PATHS = [
    f"{ROOT}/{p}"
    for p in (
        "a.txt", "b.md", ".hidden", "_under.py", "x/a.txt", "x/keep/b.md", "x/.git/config",
        "node_modules/m/index.js", "x/tmp.d/deep/er/a.txt", "x/we[ird].txt", "x/a-b.csv",
        "x/a^b.csv", "x/A.TXT", "src/a.txt", "x/report 1.txt", "x/ab.txt.bak", "x/ca.py", "x/a+b.txt",
    )
]


@pytest.fixture(scope="module")
def files(rows):
    return rows([(p,) for p in PATHS], "path string")


def paths_of(df):
    return sorted(r["path"] for r in df.select("path").collect())


def below_root(path):
    """The path and its ancestors strictly below the root."""
    steps = [PurePosixPath(path), *PurePosixPath(path).parents]
    return [s for s in steps if str(s).startswith(ROOT + "/")]


GLOBS = [
    "*.txt", "a*", "?.md", "[ab].*", "[!ab].*", "x/*.txt", "src/a.txt", "src/x", "*", "x/*/b.md",
    "we[[]ird].txt", "*.TXT", "report*", "tmp.d", f"{ROOT}/x/*.csv", "/data/*", "*/keep", "a+b.txt",
    "[a-c]*.py", "a[-^]b.csv", "**/b.md", "/data/.store/src/*",
]


def test_globs_match_pathlib(files):
    """All globs at once: a file itself, and a file with its ancestors below the root."""
    tests = []
    for i, g in enumerate(GLOBS):
        tests.append(pf.glob_matches(F.col("path"), g, ROOT).alias(f"self{i}"))
        tests.append(pf.glob_matches(F.col("path"), g, ROOT, ancestors=True).alias(f"tree{i}"))
    for r in files.select("path", *tests).collect():
        steps = below_root(r["path"])
        for i, g in enumerate(GLOBS):
            assert r[f"self{i}"] == steps[0].match(g), (r["path"], g)
            assert r[f"tree{i}"] == any(s.match(g) for s in steps), (r["path"], g)


def test_several_globs_are_alternatives(files):
    kept = paths_of(sm.exclude_glob(files, ["*.txt", "node_modules"], ROOT))
    assert kept == sorted(p for p in PATHS if not p.endswith(".txt") and "node_modules" not in p)


@pytest.mark.parametrize("pattern", [r"\.txt$", r"/x$", r"node_modules", r"^/x/keep", r"(\w)\1", r"a|_"])
def test_exclude_regex_tests_every_ancestor(files, pattern):
    def out(path):
        return any(re.search(pattern, str(s)[len(ROOT):]) for s in below_root(path))

    expected = sorted(p for p in PATHS if not out(p))
    assert paths_of(sm.exclude_regex(files, [pattern], ROOT)) == expected


def test_dot_rule_ignores_dots_above_the_root(files):
    kept = paths_of(sm.exclude_dot_paths(files, ROOT))
    assert f"{ROOT}/a.txt" in kept and f"{ROOT}/_under.py" in kept
    assert not {f"{ROOT}/.hidden", f"{ROOT}/x/.git/config"} & set(kept)


def test_depth_is_monotone_and_counts_directories(files):
    sizes = [sm.limit_depth(files, d, ROOT).count() for d in range(5)]
    assert sizes == sorted(sizes) and sizes[-1] == len(PATHS)
    assert sizes[0] == sum(p.count("/") == ROOT.count("/") + 1 for p in PATHS)


def test_one_given_side_filters_unless_strict(files):
    loose = sm.include_paths(files, globs=["*.md"], root=ROOT)
    strict = sm.include_paths(files, globs=["*.md"], root=ROOT, strict_compat=True)
    assert loose.count() == 2 and strict.count() == len(PATHS)


def test_select_files_is_the_conjunction(files):
    one = sm.select_files(
        files, ROOT, exclude_globs=["keep"], exclude_regexes=["node"], include_globs=["*.txt", "*.js"],
        include_regexes=[r"\.md$"], max_depth=2,
    )
    each = sm.limit_depth(files, 2, ROOT)
    each = sm.exclude_glob(sm.exclude_regex(each, ["node"], ROOT), ["keep"], ROOT)
    each = sm.include_paths(sm.exclude_dot_paths(each, ROOT), ["*.txt", "*.js"], [r"\.md$"], ROOT)
    assert paths_of(one) == paths_of(each) != []


def test_names_follow_pathlib(rows):
    names = ["/a/b.TXT", "/a/.bashrc", "/a/b.", "/x", "/a.b/c", "/a/b.tar.gz", "/a/..b", "rel/p.q", "bare"]
    df = rows([(n,) for n in names], "path string").select(
        "path", pf.filename(F.col("path")).alias("n"), pf.directory(F.col("path")).alias("d"),
        pf.extension(F.col("path")).alias("e"),
    )
    for r in df.collect():
        p = PurePosixPath(r["path"])
        suffix = "" if p.name.endswith(".") else p.suffix.lower()
        assert (r["n"], r["d"], r["e"]) == (p.name, str(p.parent), suffix)


def test_mime_follows_the_standard_library(rows):
    import mimetypes

    known = mimetypes.MimeTypes(filenames=())
    names = [
        "/a/x.txt", "/a/x.TXT", "/a/x.tar.gz", "/a/x.tgz", "/a/x.TGZ", "/a/x.gz", "/a/.gz", "/a/x.Z",
        "/a/x.z", "/a/x.svgz", "/a/x.csv.bz2", "/a/x.", "/a/x", "/a.b/x", "/a/..txt", "/a/x.html.br", "/a/x.py",
    ]
    got = {r["path"]: (r["mime_type"], r["encoding"]) for r in sm.guess_mime(rows([(n,) for n in names], "path string")).collect()}
    for n in names:
        mime, encoding = known.guess_type(n)
        assert got[n] == (mime or "application/octet-stream", encoding), n


def test_root_with_a_scheme(rows):
    root = "s3a://bucket/in"
    df = rows([(f"{root}/{p}",) for p in ("a.txt", "x/.h/b.txt", "x/c.md")], "path string")
    assert paths_of(sm.exclude_dot_paths(df, root)) == [f"{root}/a.txt", f"{root}/x/c.md"]
    assert paths_of(sm.limit_depth(df, 0, root)) == [f"{root}/a.txt"]
    assert paths_of(sm.exclude_regex(df, ["^/x$"], root + "/")) == [f"{root}/a.txt"]
    assert paths_of(sm.include_paths(df, globs=["x/*.md", "bucket/*"], root=root)) == [f"{root}/x/c.md"]
