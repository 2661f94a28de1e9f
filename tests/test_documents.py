"""Front matter, parsing, validation, schemas, and edits of one document."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docframe.errors import DatabaseConfigError, SchemaInvalidError, SchemaNotFoundError
from docframe.operators import edit
from docframe.sources.frontmatter import FrontMatterError, load_yaml
from docframe.sources.markdown import document_row, normalize_heading, parse_document, validate_document
from docframe.sources.schema import SCHEMA_FILE, FieldSpec, SectionSpec, TableSchema, load_database_config, load_schema, parse_schema, schema_text


@pytest.mark.parametrize(
    "text, value",
    [("2026-04-04", "2026-04-04"), ("yes", "yes"), ("12:30", "12:30"), ("010", "010"), ("1e3", 1000.0), ("0x10", 16), ("0o17", 15), ("-7", -7),
     ("~", None), ("true", True), ("1_000", "1_000"), (".5", 0.5), ("3.", 3.0), ('"a: b"', "a: b"), ("1.2.3", "1.2.3"), ("+3", 3)],
)
def test_yaml_core_types(text, value):
    found = load_yaml(f"k: {text}")["k"]
    assert found == value and type(found) is type(value)


@pytest.mark.parametrize("text", ["a: 1\na: 2", "a: [", "- x: 1\n  x: 2", "? [a]\n: 1"])
def test_yaml_errors(text):
    with pytest.raises(FrontMatterError):
        load_yaml(text)


def test_sections_fences_and_lines():
    text = "---\na: 1\n---\n# Title\nintro\n## One\n~~~~\n## no\n~~~\n```\n~~~~\n\n### deep\n# Second\n## 2. Two\n```\n## swallowed"
    doc = parse_document(text, "x.md", True)
    assert doc.h1 == "Title" and doc.h1_line == 4
    assert [(s.name, s.line) for s in doc.sections] == [("One", 6), ("Two", 15)]
    assert "## no" in doc.sections[0].body and "# Second" not in doc.sections[0].body and "### deep" in doc.sections[0].body
    assert doc.sections[1].body.endswith("## swallowed")
    assert doc.problems == ["Second H1 in line 14"]
    assert normalize_heading("12. Plan") == "Plan" and normalize_heading("v1. Plan") == "v1. Plan"


@pytest.mark.parametrize("text", ["", "no front matter", "---\na: 1", "---\n- a\n---\n", "---\na: [\n---\n"])
def test_parse_problems(text):
    doc = parse_document(text, "x.md")
    assert doc.problems and validate_document(doc, TableSchema("t"))[0].error_type == "parse_error"


def test_empty_front_matter_is_fine():
    assert parse_document("---\n---\n", "x.md").problems == []


STRICT = TableSchema(
    "t",
    {"title": FieldSpec("string", True), "n": FieldSpec("int", True), "day": FieldSpec("date"), "kind": FieldSpec("string", False, ("a", "b"))},
    {"Body": SectionSpec(required=True)},
    h1_field="title",
)
GOOD = '---\ntitle: "T"\nn: 1\n---\n# T\n## Body\nx\n'


@pytest.mark.parametrize(
    "old, new, kinds",
    [
        ("", "", []),
        ("n: 1\n", "", ["missing_field"]),
        ("n: 1", "n: true", ["type_mismatch"]),
        ("n: 1", "n: 1.0", ["type_mismatch"]),
        ("n: 1", "n: null", []),
        ('"T"', "5", ["type_mismatch", "h1_mismatch"]),
        ("n: 1", "n: 1\nday: 2024-13-01", ["type_mismatch"]),
        ("n: 1", "n: 1\nday: 2024-12-01", []),
        ("n: 1", "n: 1\nkind: c", ["enum_violation"]),
        ("n: 1", "n: 1\ncreated: 2024-01-01", ["type_mismatch"]),
        ("n: 1", "n: 1\nextra: 1", ["unknown_field"]),
        ("# T\n", "", ["missing_h1"]),
        ("# T", "# U", ["h1_mismatch"]),
        ("## Body", "## Other", ["missing_section", "unknown_section"]),
        ("x\n", "x\n## Body\n", ["duplicate_section"]),
    ],
)
def test_validation(old, new, kinds):
    text = GOOD.replace(old, new, 1) if old else GOOD
    assert [p.error_type for p in validate_document(parse_document(text, "x.md"), STRICT)] == kinds


def test_schema_errors(tmp_path):
    for text in ("", "---\ntype: other\n---\n", "---\ntype: schema\n---\n", "---\ntype: schema\ntable: t\nfrontmatter: [a]\n---\n", "---\ntype: schema\ntable: t\nfrontmatter: {a: {type: money}}\n---\n"):
        with pytest.raises(SchemaInvalidError):
            parse_schema(text)
    with pytest.raises(SchemaNotFoundError):
        load_schema(tmp_path)
    with pytest.raises(DatabaseConfigError):
        load_database_config(tmp_path)
    (tmp_path / SCHEMA_FILE).write_text("---\ntype: database\nname: x\nforeign_keys:\n  - {from: a, to: b.c}\n---\n")
    with pytest.raises(DatabaseConfigError):
        load_database_config(tmp_path)
    assert parse_schema(schema_text(STRICT)) == STRICT


def test_slug():
    assert edit.slugify("  Hello, World!_Again -- now ") == "hello-world-again-now"
    assert len(edit.slugify("x" * 200)) == 80


def test_key_edits():
    text = '---\na: 1\nb:\n  - x\n  - y\n"c d": 2\n---\nrest\n'
    assert parse_document(edit.drop_key(text, "b"), "").front == {"a": 1, "c d": 2}
    assert parse_document(edit.rename_key(text, "c d", "e"), "").front == {"a": 1, "b": ["x", "y"], "e": 2}
    assert parse_document(edit.set_key(text, "b", ['q"', "z"]), "").front["b"] == ['q"', "z"]
    assert edit.drop_key(text, "nosuch") == text and edit.rename_key("no", "a", "b") == "no"


def test_section_edits():
    text = "---\na: 1\n---\n\n# T\n\n## A\n\none\n\n## B\n\n```\n## C\n```\n\n## C\n\nthree\n"
    names = lambda x: [(s.name, s.body) for s in parse_document(x, "").sections]
    assert names(edit.rename_section(text, "C", "D"))[2] == ("D", "three")
    assert names(edit.drop_section(text, "B")) == [("A", "one"), ("C", "three")]
    assert names(edit.set_section(text, "A", "new")) [0] == ("A", "new")
    assert names(edit.merge_sections(text, ["A", "B", "C"], "All")) == [("All", "one\n\n```\n## C\n```\n\nthree")]
    assert edit.merge_sections(text, ["A", "nosuch"], "All") == text


def test_stamp_keeps_created():
    once = edit.stamp("---\na: 1\n---\n", "2024-01-01T00:00:00")
    again = edit.stamp(once, "2025-01-01T00:00:00")
    front = parse_document(again, "").front
    assert front["created"] == "2024-01-01T00:00:00" and front["modified"] == "2025-01-01T00:00:00"
    assert edit.stamp("no front matter") == "no front matter"


plain = st.text(st.characters(blacklist_categories=("Cs", "Cc"), blacklist_characters="\x85  ﻿"), max_size=30)


@settings(max_examples=150, deadline=None)
@given(
    title=plain, n=st.integers(-(2**63), 2**63 - 1), x=st.floats(allow_nan=False, allow_infinity=False), b=st.booleans(),
    tags=st.lists(plain, max_size=4), day=st.dates(), at=st.datetimes().map(lambda d: d.replace(microsecond=0)),
)
def test_documents_round_trip(title, n, x, b, tags, day, at):
    kinds = {"title": "string", "n": "int", "x": "float", "b": "bool", "tags": "string[]", "day": "date", "at": "datetime"}
    schema = TableSchema("t", {k: FieldSpec(v) for k, v in kinds.items()}, {"S": SectionSpec()}, h1_required=False)
    data = {"title": title, "n": n, "x": x, "b": b, "tags": tags, "day": day, "at": at, "S": "body"}
    doc = parse_document(edit.document_text({**data, "h1": None}, schema), "p.md")
    if not title.strip():
        assert validate_document(doc, schema) == []
    row = document_row(doc, schema)
    assert {k: row[k] for k in kinds} == {k: data[k] for k in kinds}
