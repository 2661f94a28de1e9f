"""Command line: python -m docframe."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from docframe.errors import DocframeError
from docframe.operators.catalog import FOLDER_SETTING, Database, Table, find_folder, open_folder
from docframe.plans import tree
from docframe.plans.parser import parse
from docframe.render import FORMATS, as_table, render
from docframe.sources.markdown import parse_document, validate_document
from docframe.sources.schema import SCHEMA_FILE, TableSchema


def _session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("docframe").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def discover(folder: str | None) -> Path:
    """The folder given, the nearest one at or above the working folder, or the one the environment names."""
    if folder:
        return Path(folder)
    if found := find_folder("."):
        return found
    if named := os.environ.get(FOLDER_SETTING):
        return Path(named)
    raise DocframeError(f"No {SCHEMA_FILE} here or above, and {FOLDER_SETTING} is not set")


def run_sql(target: Database | Table, sql: str, kind: str = "table", longest: int = 0) -> str:
    """A statement's result as text."""
    if isinstance(target, Database):
        out = target.execute(sql)
    else:
        out = target.execute_sql(sql) if isinstance(parse(sql), tree.Select) else target.execute(parse(sql))
    return out if isinstance(out, str) else render(*out, kind, longest)


def schema_lines(schema: TableSchema) -> list[str]:
    out = [f"Table: {schema.table} (primary key: {schema.primary_key})", "Front matter:"]
    for name, f in schema.fields.items():
        out.append(f"  {name}: {f.type}" + (" required" if f.required else "") + (f" [{', '.join(map(str, f.enum))}]" if f.enum else ""))
    h1 = "required" if schema.h1_required else "optional"
    out.append(f"H1: {h1}" + (f", equals {schema.h1_field}" if schema.h1_field else ""))
    out.append("Sections:")
    out += [f"  {name}: {s.type}" + (" required" if s.required else "") for name, s in schema.sections.items()]
    rules = ("reject_unknown_frontmatter", "reject_unknown_sections", "reject_duplicate_sections", "normalize_numbered_headings")
    return [*out, "Rules:", *(f"  {r}: {str(getattr(schema, r)).lower()}" for r in rules)]


def _validate(args: argparse.Namespace) -> int:
    target = open_folder(discover(args.folder), _session())
    found = target.validate()
    if not args.quiet:
        for p in found:
            print(f"{p.file_path}" + (f":{p.line_number}" if p.line_number else "") + f": [{p.error_type}] {p.message}")
    hard = [p for p in found if args.strict or p.error_type not in ("fk_violation", "fk_missing_table")]
    print(f"{len(found)} problems" if found else "All documents are valid")
    return 1 if hard else 0


def _query(args: argparse.Namespace) -> int:
    target = open_folder(discover(args.folder), _session())
    print(run_sql(target, args.sql, args.format, args.truncate))
    if isinstance(target, Database) and args.check_keys:
        for r in target.foreign_key_errors().limit(20).collect():
            print(f"warning: {r['file_path']}: {r['message']}", file=sys.stderr)
    return 0


def _create(args: argparse.Namespace) -> int:
    table = Table(discover(args.folder), _session())
    data = {}
    for pair in args.set or ():
        key, found, value = pair.partition("=")
        if not found:
            raise DocframeError(f"Expected key=value, got '{pair}'")
        data[key.strip()] = value
    print(table.insert(data, filename=args.file))
    return 0


def _inspect(args: argparse.Namespace) -> int:
    folder = discover(args.folder)
    table = Table(folder, _session()) if not args.file else None
    if table:
        rows, columns = table.query(f"SELECT * FROM {table.name} ORDER BY path")
        print(as_table(rows, columns, 40))
        return 0
    from docframe.sources.schema import load_schema

    schema = load_schema(folder)
    doc = parse_document((folder / args.file).read_text("utf-8"), args.file, schema.normalize_numbered_headings)
    print(f"{args.file}\n  h1: {doc.h1}")
    for k, x in doc.front.items():
        print(f"  {k}: {x!r}")
    for s in doc.sections:
        print(f"  ## {s.name} (line {s.line}, {len(s.body)} characters)")
    found = validate_document(doc, schema)
    for p in found:
        print(f"  [{p.error_type}] {p.message}")
    return 1 if found else 0


def _schema(args: argparse.Namespace) -> int:
    target = open_folder(discover(args.folder), _session())
    if isinstance(target, Table):
        print("\n".join(schema_lines(target.schema)))
        return 0
    print(f"Database: {target.name}")
    for name in target.tables:
        print("\n".join(["", *schema_lines(target.table(name).schema)]))
    for k in target.config.foreign_keys:
        print(f"\nForeign key: {k.from_table}.{k.from_column} -> {k.to_table}.{k.to_column}")
    for v in target.config.views:
        print(f"\nView: {v.name} AS {v.query}")
    return 0


def _stamp(args: argparse.Namespace) -> int:
    print(f"Stamped {Table(discover(args.folder), _session()).stamp()} files")
    return 0


def _repl(args: argparse.Namespace) -> int:
    from docframe.repl import Shell

    Shell(open_folder(discover(args.folder), _session())).cmdloop()
    return 0


def _rename(args: argparse.Namespace) -> int:
    print(Database(discover(args.folder), _session()).rename(args.table, args.old, args.new))
    return 0


def _client(args: argparse.Namespace) -> int:
    from docframe.server import serve

    serve(Database(discover(args.folder), _session()), args.port, args.host)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="docframe", description="Tables of Markdown documents, queried with SQL.")
    sub = top.add_subparsers(dest="command")

    def add(name: str, run, text: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=text)
        p.set_defaults(run=run)
        return p

    p = add("validate", _validate, "check documents, foreign keys and views")
    p.add_argument("folder", nargs="?")
    p.add_argument("--strict", action="store_true", help="foreign-key violations fail too")
    p.add_argument("-q", "--quiet", action="store_true")
    p = add("query", _query, "run a statement")
    p.add_argument("folder")
    p.add_argument("sql")
    p.add_argument("--format", "-f", choices=FORMATS, default="table")
    p.add_argument("--truncate", "-t", type=int, default=0)
    p.add_argument("--check-keys", action="store_true", help="also report foreign-key violations")
    p = add("create", _create, "write a new document")
    p.add_argument("folder", nargs="?")
    p.add_argument("-s", "--set", action="append", metavar="KEY=VALUE")
    p.add_argument("--file")
    p = add("inspect", _inspect, "show parsed documents")
    p.add_argument("folder", nargs="?")
    p.add_argument("-f", "--file")
    p = add("schema", _schema, "show the schema")
    p.add_argument("folder", nargs="?")
    p = add("stamp", _stamp, "set created and modified")
    p.add_argument("folder", nargs="?")
    p = add("repl", _repl, "interactive statements")
    p.add_argument("folder", nargs="?")
    p = add("rename", _rename, "rename a document and the references to it")
    p.add_argument("folder")
    p.add_argument("table")
    p.add_argument("old")
    p.add_argument("new")
    p = add("client", _client, "web interface")
    p.add_argument("folder", nargs="?")
    p.add_argument("-p", "--port", type=int, default=3000)
    p.add_argument("--host", default="127.0.0.1")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if not args.command:
        args.run, args.folder = _repl, None
    try:
        return args.run(args)
    except (DocframeError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
