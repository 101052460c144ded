"""Path columns and plan-time translation of globs to regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DOT_SEGMENT = r"/\.[^/]*(/|$)"


def filename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """The parent: ``/`` for a top-level path, ``.`` for a bare name."""
    parent = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return (
        F.when(parent != "", parent)
        .when(F.startswith(path, F.lit("/")), F.lit("/"))
        .otherwise(F.lit("."))
    )


def extension(path: Column) -> Column:
    """Lower-case last suffix with its dot; empty for none, for dot files and a final dot."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def normalize_root(root: str) -> str:
    """The root without a final slash; a root with a scheme keeps it as it is."""
    if "://" in root:
        return root.rstrip("/")
    return "/" + root.strip("/") if root.strip("/") else ""


def below_root(path: Column, root: str = "/") -> Column:
    """The part of an absolute path below the root, with its leading slash."""
    prefix = normalize_root(root)
    return F.substr(path, F.lit(len(prefix) + 1)) if prefix else path


def depth(path: Column, root: str = "/") -> Column:
    """Number of directories between the root and the file (0 for the root's own files)."""
    inner = below_root(path, root)
    return F.length(inner) - F.length(F.replace(inner, F.lit("/"))) - 1


def self_and_ancestors(path: Column, root: str = "/") -> Column:
    """The absolute path and every directory of it strictly below the root."""
    prefix = normalize_root(root)
    parts = F.split(F.substr(below_root(path, root), F.lit(2)), "/", -1)
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.concat(F.lit(prefix + "/"), F.array_join(F.slice(parts, F.lit(1), i), "/")),
    )


def _segment_regex(segment: str) -> str:
    out, i = [], 0
    while i < len(segment):
        ch = segment[i]
        if ch == "*":
            if not out or out[-1] != "[^/]*":
                out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif ch == "[":
            # A leading "]" (after an optional "!") is a member, not the end.
            start = i + 2 if segment[i + 1 : i + 2] == "!" else i + 1
            end = segment.find("]", start + 1)
            if end < 0:
                out.append(r"\[")
            else:
                members = re.sub(r"([\\\[\]^&~|])", r"\\\1", segment[start:end])
                negated = start == i + 2
                out.append(f"[^/{members}]" if negated else f"[{members}]")
                i = end
        else:
            out.append(re.sub(r"([^\w])", r"\\\1", ch, flags=re.ASCII) if ord(ch) < 128 else ch)
        i += 1
    return "".join(out)


def glob_parts(pattern: str) -> tuple[list[str], bool]:
    """Segment expressions of a glob and whether it is anchored at the file system root."""
    segments = [s for s in pattern.split("/") if s not in ("", ".")]
    if not segments:
        raise ValueError("empty glob pattern")
    return [_segment_regex(s) for s in segments], pattern.startswith("/")


def glob_matches(path: Column, pattern: str, root: str = "/", ancestors: bool = False) -> Column:
    """Right-anchored glob match of the file (or, with ``ancestors``, of any directory on
    the way to it below the root).

    A glob matches as many path segments as it has, so instead of testing a list of
    ancestors one expression is tested against the path below the root, extended by the
    last ``n - 1`` segments of the root that such a glob may reach into.
    """
    segments, absolute = glob_parts(pattern)
    root_segments = [s for s in root.split("/") if s]
    end = "(/|$)" if ancestors else "$"
    body = "/" + "/".join(segments) + end
    if absolute:
        if len(segments) <= len(root_segments):
            return F.lit(False)
        return path.rlike("^" + body)
    reach = root_segments[len(root_segments) - (len(segments) - 1):] if len(segments) > 1 else []
    inner = below_root(path, root)
    subject = F.concat(F.lit("/" + "/".join(reach)), inner) if reach else inner
    return subject.rlike(body)
