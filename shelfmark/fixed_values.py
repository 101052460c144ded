"""Results depend on them, so they are stated as they are.

Word lists, suffix lists, patterns and default limits of the metadata model.
Nothing here is derived; everything else in the package is parameterised.
"""

# Common words counted per language.
LANGUAGE_WORDS = {
    "en": ["the", "and", "is", "in", "to", "of", "that", "for"],
    "es": ["el", "la", "es", "en", "y", "de", "que", "por"],
    "fr": ["le", "la", "est", "en", "et", "de", "que", "pour"],
}
UNKNOWN_LANGUAGE = "unknown"

# Words that are never keywords.
STOP_WORDS = [
    "the", "and", "is", "in", "to", "of", "that", "for", "on", "with", "as", "this", "by",
]
MIN_KEYWORD_LENGTH = 3

# One word is a maximal run of letters, digits and underscores.
WORD_PATTERN = r"[\p{L}\p{N}_]+"

# Which suffixes and MIME prefixes each profile applies to, in merge order.
PROFILE_ROUTES = [
    ("text",
     [".txt", ".md", ".rst", ".csv", ".json", ".xml", ".html", ".htm", ".yaml", ".yml"],
     ["text/"]),
    ("image",
     [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".tiff", ".tif", ".webp", ".svg", ".ico",
      ".heic", ".heif"],
     ["image/"]),
    ("tabular",
     [".csv", ".tsv", ".xlsx", ".xls", ".ods", ".json", ".xml"],
     ["text/csv", "application/vnd.ms-excel",
      "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
      "application/vnd.oasis.opendocument.spreadsheet"]),
    ("hdf",
     [".h5", ".hdf", ".hdf5", ".he5", ".h4", ".hdf4"],
     ["application/x-hdf", "application/x-hdf5"]),
    ("pdf", [".pdf"], ["application/pdf"]),
    ("python", [".py", ".pyi", ".pyx", ".pyw"], ["text/x-python", "text/x-script.python"]),
    ("json", [".json"], ["application/json"]),
    ("yaml", [".yaml", ".yml"], ["application/x-yaml", "text/yaml"]),
]
DEFAULT_MIME_TYPE = "application/octet-stream"

# The value patterns of column type detection.
DATE_PREFIX_PATTERNS = [r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}", r"\d{2}-\d{2}-\d{4}"]
BOOLEAN_WORDS = ["true", "false", "yes", "no", "1", "0", "t", "f", "y", "n"]

# Top-level module names that count as the standard library.
STANDARD_LIBRARY_MODULES = [
    "abc", "argparse", "ast", "asyncio", "base64", "collections", "concurrent",
    "contextlib", "copy", "csv", "datetime", "decimal", "difflib", "enum", "functools",
    "glob", "gzip", "hashlib", "http", "importlib", "inspect", "io", "itertools", "json",
    "logging", "math", "multiprocessing", "os", "pathlib", "pickle", "random", "re",
    "shutil", "signal", "socket", "sqlite3", "statistics", "string", "subprocess", "sys",
    "tempfile", "threading", "time", "traceback", "typing", "unittest", "urllib", "uuid",
    "warnings", "weakref", "xml", "zipfile",
]

# Syntax node kinds that count as a statement, and those that branch.
STATEMENT_KINDS = [
    "Assign", "AugAssign", "Return", "Raise", "Assert", "Import", "ImportFrom", "If", "For",
    "While", "Try", "ExceptHandler", "Pass", "Break", "Continue",
]
BRANCH_KINDS = {"if": "If", "for": "For", "while": "While", "try": "Try"}

# Luma weights of the brightness formula.
LUMA_WEIGHTS = (0.299, 0.587, 0.114)

# Camera tag -> output field.
EXIF_FIELDS = {
    "Make": "camera_make",
    "Model": "camera_model",
    "DateTimeOriginal": "date_taken",
    "ExposureTime": "exposure_time",
    "FNumber": "f_number",
    "ISOSpeedRatings": "iso",
    "FocalLength": "focal_length",
}

# Default limits that are part of the output's meaning.
PREVIEW_CHARS = 1000
PAGE_PREVIEW_CHARS = 10_000
KEYWORDS_PER_FILE = 10
ATTRIBUTES_PER_ITEM = 20
DOMINANT_VALUES = 5
TEXT_PAGES = 5
FLAG_PAGES = 3
BATCH_SIZE = 100
FACET_SIZE = 10
RESULTS_PER_PAGE = 10
SUBJECT_PREFIX = "file://"
PUBLIC = "public"
