"""Functions on single files and folders, by path."""

from __future__ import annotations

import datetime as dt
import re
from pathlib import Path

from pyspark.sql import SparkSession

from docframe.operators import edit, txn
from docframe.operators.catalog import open_folder
from docframe.sources import schema as sch
from docframe.sources.markdown import Document, Problem, parse_date, parse_document, validate_document

_PLAIN_DATE = re.compile(r"^([^\s:#][^:]*):[ \t]+(\d{4}-\d{2}-\d{2})[ \t]*(?:#.*)?$", re.MULTILINE)


def parse_file(path: str | Path, relative_to: str | Path | None = None, normalize: bool = False) -> Document:
    """A parsed document; front-matter dates without quotes are date values here."""
    path = Path(path)
    text = path.read_text("utf-8")
    doc = parse_document(text, str(path.relative_to(relative_to)) if relative_to else path.name, normalize)
    for m in _PLAIN_DATE.finditer(sch.split_document(text)[0] or ""):
        key = m[1].strip().strip("\"'")
        if isinstance(doc.front.get(key), str) and (day := parse_date(m[2])):
            doc.front[key] = day
    return doc


def validate_file(path: str | Path, schema: sch.TableSchema) -> list[Problem]:
    path = Path(path)
    return validate_document(parse_document(path.read_text("utf-8"), path.name, schema.normalize_numbered_headings), schema)


def load_table(folder: str | Path, spark: SparkSession | None = None) -> tuple[sch.TableSchema, list[dict[str, object]], list[Problem]]:
    """(schema, valid rows, problems) of a table folder."""
    from docframe.operators.catalog import Table

    table = Table(folder, spark)
    return table.schema, table.load(), table.validate()


def execute_query_folder(folder: str | Path, sql: str, spark: SparkSession | None = None) -> tuple[list[dict[str, object]], list[str]]:
    """A SELECT over a table or database folder."""
    target = open_folder(folder, spark)
    return target.query(sql)


def _rewrite(path: str | Path, change) -> bool:
    path = Path(path)
    old = path.read_text("utf-8")
    if (new := change(old)) == old:
        return False
    txn.atomic_write(path, new)
    return True


def stamp_file(path: str | Path, now: dt.datetime | None = None) -> bool:
    """Sets created if missing, and modified; False for a file without front matter."""
    return _rewrite(path, lambda x: edit.stamp(x, now.isoformat(timespec="seconds") if now else None))


def rename_frontmatter_key_in_file(path: str | Path, old: str, new: str) -> bool:
    return _rewrite(path, lambda x: edit.rename_key(x, old, new))


def drop_frontmatter_key_in_file(path: str | Path, key: str) -> bool:
    return _rewrite(path, lambda x: edit.drop_key(x, key))


def rename_section_in_file(path: str | Path, old: str, new: str, normalize: bool = False) -> bool:
    return _rewrite(path, lambda x: edit.rename_section(x, old, new, normalize))


def drop_section_in_file(path: str | Path, name: str, normalize: bool = False) -> bool:
    return _rewrite(path, lambda x: edit.drop_section(x, name, normalize))


def merge_sections_in_file(path: str | Path, names: list[str], into: str, normalize: bool = False) -> bool:
    return _rewrite(path, lambda x: edit.merge_sections(x, names, into, normalize))


def update_schema(path: str | Path, rename: tuple[str, str] | None = None, drop: str | None = None) -> bool:
    """Renames or drops a field or section in a schema file."""

    def change(text: str) -> str:
        schema = sch.parse_schema(text, str(path))
        if rename:
            schema = sch.renamed(schema, *rename)
        if drop:
            schema = sch.without(schema, drop)
        return sch.schema_text(schema, sch.split_document(text)[1])

    return _rewrite(path, change)


atomic_write = txn.atomic_write
recover_journal = txn.recover
