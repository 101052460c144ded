"""From files to a catalog, and from a catalog to an index."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import paths
from ..functions.text import lower_words
from ..operators.children import container_profiles, merge_children, read_containers
from ..operators.code import code_struct, module_facts
from ..operators.identity import basic_metadata, suffix_types
from ..operators.merging import extraction_errors, merge_profiles
from ..operators.publishing import is_publishable, latest_per_key, to_entries, upsert_entries
from ..operators.routing import Registry, default_registry, route_extractors
from ..operators.selection import select_files
from ..operators.semistructured import json_judgement, json_struct, yaml_struct
from ..operators.tabular import file_cells, profile_files
from ..operators.text import profile_pieces, text_fields
from ..sources.files import (
    is_long,
    max_length,
    qualified_root,
    read_text_content,
    scan_files,
    text_pieces,
    with_bytes,
)
from ..session import work_dir
from . import index_store

ROW_PROFILES = ["text", "python", "json", "yaml"]
PREFIX = "profile_"
TABLE_SUFFIXES = [".csv", ".tsv", ".json"]
FILE_ONLY = ("content", "filename", "directory", "extension", "depth")  # columns that a record does not keep


def _for_profile(name: str, content: Column) -> Column:
    """The content where the profile applies, else null, which every profile skips."""
    return F.when(F.array_contains("profiles", name), content)


def catalog_from_files(
    files: DataFrame,
    root: str = "/",
    select: Mapping[str, Any] | None = None,
    max_chars: int | None = None,
    max_document_chars: int | None = None,
    tabular: bool = True,
    table_files: DataFrame | None = None,
    sample_rows: int | None = None,
    local_prefixes: Sequence[str] = (),
    registry: Registry | None = None,
    keep_profiles: bool = False,
    children: Mapping[str, DataFrame] | None = None,
    pieces: DataFrame | None = None,
) -> DataFrame:
    """One typed record per file: select, route, profile and merge as one lazy plan.

    ``files`` has ``path``, ``size_bytes`` and text ``content``. The path rules in
    ``select`` come first, so nothing is computed for files they drop. Profiles are
    columns of the file's own row; only the tabular profile regroups cells and is joined
    back by path. ``table_files`` may name a cheaper source of the tabular files alone.
    ``pieces`` are the decoded texts of the long files among them (see ``text_pieces``); the
    text profile of these comes from the pieces, whether ``files`` has their content or not.
    ``children`` are profiles of pages, pixels or arrays, one row per path, which the
    records take in under their names (see ``merge_children``).
    """
    registry = registry or default_registry
    chosen = select_files(files, root=root, **(select or {}))
    routed = route_extractors(basic_metadata(chosen), registry)
    content = F.col("content")
    # What several fields share is computed once, below the structs that use it.
    shared = routed.withColumns(
        {"__text": _for_profile("text", content), "__code": _for_profile("python", content),
         "__json": _for_profile("json", content), "__yaml": _for_profile("yaml", content)}
    )
    if pieces is not None:
        shared = shared.withColumn("__text", F.when(~is_long(F.col("size_bytes")), F.col("__text")))
    if max_chars is not None:
        shared = shared.withColumn("__text", F.substring("__text", 1, max_chars))
    shared = shared.withColumns(
        {
            "__words": lower_words(F.col("__text")),
            "__valid": json_judgement(F.col("__json"), max_document_chars),
            "__facts": module_facts(F.col("__code")),
        }
    )
    profiles = {
        "python": code_struct(F.col("__code"), F.col("__facts"), local_prefixes),
        "json": json_struct(F.col("__json"), F.col("__valid"), max_document_chars),
        "yaml": yaml_struct(F.col("__yaml")),
    }
    for name, fn in registry.functions.items():
        profiles[name] = fn(_for_profile(name, content))
    kept = [c for c in shared.columns if not c.startswith("__") and c not in FILE_ONLY]
    texts = {f"__text_{n}": c for n, c in text_fields(F.col("__text"), F.col("__words")).items()}
    computed = {PREFIX + n: c for n, c in profiles.items()} | texts
    profiled = shared.select(*kept, *[c.alias(n) for n, c in computed.items()])
    if pieces is not None:
        profiled = _with_long_texts(profiled, profile_pieces(pieces))
    order = [PREFIX + n for n in [*ROW_PROFILES, *registry.functions]]
    if "text" in profiles:
        record = merge_profiles(profiled, order)
    else:
        # The text fields are columns, the last choice of the merge: of a struct over a join Spark
        # would compute the fields that nobody reads as well.
        own = {n.removeprefix("__text_"): F.col(n) for n in texts}
        profiled = profiled.withColumns({n: F.coalesce(c, n) if n in kept else c for n, c in own.items()})
        if keep_profiles:
            profiled = profiled.withColumn(order[0], F.struct(*[c.alias(n) for n, c in own.items()]))
        record = merge_profiles(profiled, order[1:])
    shown = [*kept, *(dict.fromkeys(order) if keep_profiles else ())]
    record = record.select(*shown, *[c for c in record.columns if c not in (*shown, *order, *texts)])
    record = merge_children(record, children or {})
    if not tabular:
        return record

    # Only tabular files are cut into cells.
    candidates = chosen if table_files is None else select_files(
        table_files, root=root, **(select or {})
    )
    cells = file_cells(
        candidates.where(paths.extension(F.col("path")).isin(*TABLE_SUFFIXES)),
        sample_rows=sample_rows,
    )
    tables = profile_files(cells).withColumnRenamed("line_count", "record_lines")
    # What kind of table a file is, and JSON files that are none.
    suffix = paths.extension(F.col("path"))
    return record.join(tables, "path", "left").withColumns(
        {
            "format": F.when(suffix.isin(*TABLE_SUFFIXES), F.substr(suffix, F.lit(2))),
            "structure": F.when((suffix == ".json") & F.col("column_count").isNull(), F.lit("non-tabular")),
        }
    )


def _with_long_texts(profiled: DataFrame, texts: DataFrame) -> DataFrame:
    """Put the text profiles of long files, one row per path, into the ``__text_`` columns of their files."""
    named = texts.select("path", *[F.col(c).alias(f"__long_{c}") for c in texts.columns if c != "path"])
    joined = profiled.join(named, "path", "left")
    merged = {c: F.coalesce(f"__long_{c.removeprefix('__text_')}", c) for c in profiled.columns if c.startswith("__text_")}
    if "read_error" in profiled.columns:
        merged["read_error"] = F.coalesce("read_error", "__long_read_error")
    return joined.withColumns(merged).select(*profiled.columns)


def _route_suffixes(registry: Registry, names: Iterable[str]) -> set[str]:
    """The suffixes of all files that some of these profiles may take."""
    routes = [r for r in registry.routes if r.name in names]
    suffixes = {s for r in routes for s in r.suffixes}
    prefixes = tuple(p for r in routes for p in r.mime_prefixes)
    return suffixes | {s for s, mime in suffix_types().items() if mime.startswith(prefixes)}


def _has_suffix(suffixes: Iterable[str]) -> Column:
    return F.coalesce(paths.extension(F.col("path")).isin(sorted(suffixes)), F.lit(False))


def _tree(
    spark: SparkSession, root: str, listed: DataFrame | None, select: Mapping[str, Any],
    suffixes: Sequence[str], in_pieces: Column | None = None,
) -> DataFrame:
    """Selected files with the content of those that a profile takes.

    On a mounted tree (``listed``) the path rules come before any file is opened, and files that
    are read in pieces elsewhere are not. Elsewhere Spark reads
    the files of the suffixes in question up to its length limit, and lists the others
    without opening them. A file that a profile would take but that is too long gets a
    ``read_error`` and no content.
    """
    base, limit = qualified_root(spark, root), max_length(spark)
    taken = _has_suffix(suffixes)
    fits = F.col("size_bytes") <= limit
    if listed is not None:
        wanted = taken & F.coalesce(fits, F.lit(False))
        files = with_bytes(listed, wanted if in_pieces is None else wanted & ~in_pieces)
    else:
        opened = scan_files(spark, root, with_content=True, hidden=False, suffixes=suffixes)
        rest = scan_files(spark, root, hidden=False).withColumn("content", F.lit(None).cast("binary"))
        # The bound on the length reaches the scan, which does not open longer files.
        files = opened.where(fits & taken).unionByName(rest.where(~(taken & fits)))
        files = select_files(files, root=base, **select).withColumn("read_error", F.lit(None).cast("string"))
    too_long = F.when(taken & ~fits & F.col("read_error").isNull(), F.lit(f"longer than {limit} bytes; not read"))
    return read_text_content(files.withColumn("read_error", F.coalesce("read_error", too_long)))


def build_catalog(
    spark: SparkSession, root: str, hidden: bool | None = None, **options: Any
) -> DataFrame:
    """The catalog of a file tree; see ``catalog_from_files`` for the options and
    ``scan_files`` for ``hidden``.

    Only files that a profile takes are opened; ``read_error`` tells why one could not be.
    The tabular profile reads the tabular files a second time, and no others. On a mounted tree
    the texts of long files are read and profiled in pieces, unless ``max_chars`` is given. Files whose
    suffix is one of ``containers`` hold pages, pixels and arrays (see ``read_containers``);
    they are parsed once into the shared work folder, and their child tables are profiled
    from there into the fields ``pages``, ``image`` and ``arrays``.
    """
    registry = options.get("registry") or default_registry
    containers = options.pop("containers", ())
    select = options.pop("select", None) or {}
    base, listed, in_pieces = qualified_root(spark, root), None, None
    whole = {*ROW_PROFILES, *registry.functions} - ({"text"} - set(registry.functions))
    suffixes = _route_suffixes(registry, [*ROW_PROFILES, *registry.functions]) | set(TABLE_SUFFIXES)
    if hidden or (hidden is None and base.startswith("/")):
        listed = select_files(scan_files(spark, root, hidden=hidden), root=base, **select)
    if listed is not None and options.get("max_chars") is None and "text" not in whole:
        fits = F.col("read_error").isNull() & (F.col("size_bytes") <= max_length(spark))
        long = listed.where(is_long(F.col("size_bytes")) & fits & _has_suffix(_route_suffixes(registry, ["text"])))
        if not long.isEmpty():
            options["pieces"] = read_text_content(text_pieces(long))
            # Only what some other profile takes is read whole as well.
            in_pieces = is_long(F.col("size_bytes")) & ~_has_suffix(_route_suffixes(registry, whole))
    files = _tree(spark, root, listed, select, sorted(suffixes), in_pieces)
    tables = None
    if options.get("tabular", True):
        tables = _tree(spark, root, listed, select, TABLE_SUFFIXES)
    if containers:
        held = _tree(spark, root, listed, select, containers)
        held = held.where(F.col("content").isNotNull() & paths.extension(F.col("path")).isin(*containers))
        target = f"{work_dir(spark)}/containers-{uuid.uuid4().hex}"
        read_containers(held).write.parquet(target)
        options["children"] = {**container_profiles(spark.read.parquet(target)), **(options.get("children") or {})}
    return catalog_from_files(files, root=base, select={"ignore_dot_paths": False}, table_files=tables, **options)


def catalog_errors(catalog: DataFrame) -> DataFrame:
    """``path, profile, error`` of failed profiles, from a catalog built with
    ``keep_profiles`` (which leaves one ``profile_<name>`` column per profile); files that
    could not be read come with profile ``content``."""
    failing = [
        field.name
        for field in catalog.schema.fields
        if field.name.startswith(PREFIX)
        and isinstance(field.dataType, StructType)
        and "error" in field.dataType.fieldNames()
    ]
    errors = extraction_errors(catalog, failing)
    errors = errors.withColumn("profile", F.substr("profile", F.lit(len(PREFIX) + 1)))
    if "read_error" not in catalog.columns:
        return errors
    unread = catalog.where(F.col("read_error").isNotNull())
    return errors.unionByName(unread.select("path", F.lit("content").alias("profile"), F.col("read_error").alias("error")))


def refresh_index(
    spark: SparkSession,
    catalog: DataFrame,
    index_path: str,
    prefix: str = "file://",
    visible_to: Sequence[str] | Column | None = None,
) -> DataFrame:
    """Publish a catalog: entries, upsert into the stored index, and a one-row summary.

    The catalog is computed once, into a staged table, and the summary is observed on the
    way. Only the buckets of the incoming subjects are rewritten (see ``index_store``);
    readers never see a half-written index and a failed run leaves the old one in place. Of
    several rows of one subject the last by path and content hash stays. Entries without a
    subject are counted and left out.
    """
    seen = Observation()
    incoming = to_entries(catalog, prefix, visible_to).observe(
        seen,
        F.count_if(is_publishable()).alias("succeeded"),
        F.count_if(~is_publishable()).alias("failed"),
    )
    path = f"{work_dir(spark)}/entries-{uuid.uuid4().hex}"
    latest_per_key(incoming.where(is_publishable()), "subject").write.parquet(path)
    staged = spark.read.schema(incoming.schema).parquet(path)
    index_store.write_buckets(
        spark, staged, index_path, lambda old, new: upsert_entries(old, new, incoming_is_unique=True)
    )
    counts = seen.get
    return spark.createDataFrame(
        [(counts["succeeded"], counts["failed"])], "succeeded bigint, failed bigint"
    )
