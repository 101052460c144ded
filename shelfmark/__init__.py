"""A metadata catalog over very many files and rows, as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The few helpers that run in Python workers travel with the query, so executors need no
# copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .operators.arrays import array_layout, array_statistics, dataset_totals, list_hierarchy
from .operators.children import (
    array_profile,
    colour_profile,
    container_profiles,
    container_tables,
    merge_children,
    page_profile,
    read_containers,
)
from .operators.code import (
    code_complexity,
    code_imports,
    code_symbols,
    comment_stats,
    import_frequency,
)
from .operators.distributions import average_color, dominant_values, image_geometry
from .operators.identity import basic_metadata, file_identity, guess_mime
from .operators.merging import count_errors, extraction_errors, merge_profiles
from .operators.paged import any_in_first_pages, join_first_pages, page_count, page_text_stats
from .operators.publishing import (
    batch_entries,
    delete_entries,
    index_stats,
    latest_per_key,
    number_batches,
    publish_summary,
    to_entries,
    upsert_entries,
)
from .operators.routing import Registry, register_extractor, route_extractors
from .operators.search import (
    detail_view,
    filter_date_range,
    filter_terms,
    get_entry,
    page_results,
    result_view,
    term_facets,
    visible_entries,
)
from .operators.selection import (
    exclude_dot_paths,
    exclude_glob,
    exclude_regex,
    include_paths,
    limit_depth,
    select_files,
)
from .operators.semistructured import json_profile, json_validity, key_frequency, yaml_profile
from .operators.tabular import (
    column_statistics,
    infer_column_types,
    profile_table,
    table_shape,
)
from .operators.text import extract_keywords, language_breakdown, text_profile
from .plans.catalog import build_catalog, catalog_errors, catalog_from_files, refresh_index
from .plans.index_store import clean_up, lookup_entry, read_index
from .session import configure
from .sources.catalog_json import read_catalog_json, to_index_schema, write_catalog_json
from .sources.changes import listing_changes, next_listing
from .sources.files import files_from_table, read_text_content, scan_files
from .sources.tables import json_table_summary, read_delimited, read_json_records

__all__ = [name for name in dir() if not name.startswith("_") and name not in ("sys", "cloudpickle")]
