"""docframe: document tables and an SQL dialect on Spark DataFrames."""

from __future__ import annotations

import importlib
from typing import Any

#: Public names and their modules; they are imported when first used, so that workers load only what a task needs.
_PLACES = {
    "Database": "operators.catalog",
    "Table": "operators.catalog",
    "execute_rows": "operators.catalog",
    "open_folder": "operators.catalog",
    "DocframeError": "errors",
    "slugify": "operators.edit",
    "parse_query": "plans.parser",
    "normalize_heading": "sources.markdown",
    "parse_document": "sources.markdown",
    "validate_document": "sources.markdown",
    "load_schema": "sources.schema",
    "parse_file": "files",
    "validate_file": "files",
    "load_table": "files",
    "execute_query_folder": "files",
    "stamp_file": "files",
    "atomic_write": "files",
    "recover_journal": "files",
    "rename_frontmatter_key_in_file": "files",
    "drop_frontmatter_key_in_file": "files",
    "rename_section_in_file": "files",
    "drop_section_in_file": "files",
    "merge_sections_in_file": "files",
    "update_schema": "files",
    "FieldIndex": "operators.field_index",
    "load_pandas": "bridges",
    "load_polars": "bridges",
    "to_pandas": "bridges",
    "to_polars": "bridges",
}
__all__ = list(_PLACES)


def __getattr__(name: str) -> Any:
    if name not in _PLACES:
        raise AttributeError(f"module 'docframe' has no attribute '{name}'")
    module = importlib.import_module(f"docframe.{_PLACES[name]}")
    return getattr(module, "parse" if name == "parse_query" else name)
