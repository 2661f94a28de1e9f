"""Functions by path, the value index, and search over a written index."""

import datetime as dt

import docframe
from docframe.operators.search import build_index, search, search_index
from docframe.sources.schema import SCHEMA_FILE


def test_functions_by_path(spark, shop):
    first = shop / "orders/first.md"
    first.write_text(first.read_text().replace('due: "2024-05-01"', "due: 2024-05-01"))
    doc = docframe.parse_file(first, shop, True)
    assert doc.path == "orders/first.md" and doc.front["due"] == dt.date(2024, 5, 1) and doc.front["created"] == "2024-01-02T03:04:05"
    schema, rows, problems = docframe.load_table(shop / "orders", spark)
    assert schema.table == "orders" and len(rows) == 3 and {p.file_path for p in problems} == {"broken.md"}
    assert docframe.validate_file(first, schema) == []
    assert docframe.execute_query_folder(shop, "SELECT COUNT(*) n FROM tags", spark)[0] == [{"n": 2}]
    assert docframe.stamp_file(first, dt.datetime(2025, 1, 1)) and docframe.parse_file(first).front["modified"] == "2025-01-01T00:00:00"
    assert docframe.rename_frontmatter_key_in_file(first, "amount", "total") and not docframe.rename_frontmatter_key_in_file(first, "amount", "x")
    assert docframe.drop_frontmatter_key_in_file(first, "tags") and "tags" not in docframe.parse_file(first).front
    assert docframe.rename_section_in_file(first, "Go-Live Notes", "Notes") and docframe.merge_sections_in_file(first, ["Summary", "Notes"], "All", True)
    assert [s.name for s in docframe.parse_file(first).sections] == ["All"] and docframe.drop_section_in_file(first, "All")
    assert docframe.parse_file(first).sections == []
    assert docframe.update_schema(shop / "orders" / SCHEMA_FILE, rename=("amount", "total"), drop="tags")
    schema = docframe.load_schema(shop / "orders")
    assert "total" in schema.fields and "tags" not in schema.fields


def test_field_index(spark):
    rows = [("a", 5, -1.5, "x", ["l"]), ("b", 10, 2.0, "y", None), ("c", None, -3.0, "x", [])]
    df = spark.createDataFrame(rows, "path string, n int, f double, s string, t array<string>")
    index = docframe.FieldIndex(df, "path", ["n", "f", "s", "t"])
    keys = lambda d: sorted(r[0] for r in d.collect())
    assert keys(index.compare("f", "<", 0)) == ["a", "c"] and keys(index.compare("n", ">=", 10)) == ["b"]
    assert keys(index.between("f", -3, -1.5)) == ["a", "c"] and keys(index.one_of("s", ["y", "z"])) == ["b"]
    assert keys(index.both(index.compare("s", "=", "x"), index.compare("n", "=", 5))) == ["a"]
    assert keys(index.either(index.compare("s", "=", "y"), index.compare("n", "=", 5))) == ["a", "b"]
    assert keys(index.compare("t", "=", "l")) == [] and keys(index.one_of("s", [])) == []
    index.update(spark.createDataFrame([("a", 7, 0.0, "z", None), ("d", 1, 1.0, "x", None)], df.schema))
    assert keys(index.compare("s", "=", "x")) == ["c", "d"] and keys(index.compare("n", "=", 5)) == []
    index.invalidate(spark.createDataFrame([("c",)], "key string"))
    assert keys(index.compare("s", "=", "x")) == ["d"]


def test_search_over_an_index(spark, tmp_path):
    df = spark.createDataFrame([("a", "red red blue", "x"), ("b", "blue", "red"), ("c", None, "green")], "path string, t string, u string")
    build_index(df, "path", ["t", "u"]).write.parquet(str(tmp_path / "i"))
    index = spark.read.parquet(str(tmp_path / "i"))
    assert {r["key"] for r in search_index(index, "RED!").collect()} == {"a", "b"} == {r["key"] for r in search(df, "red", "path", ["t", "u"]).collect()}
    assert [r["key"] for r in search_index(index, "red", "t").collect()] == ["a"]
    ranked = [r["key"] for r in search(df, "red blue", "path", ["t"]).collect()]
    assert ranked == [r["key"] for r in search_index(index, "red blue", "t").collect()] == ["a", "b"]
    assert search_index(index, "!").count() == 0 and search_index(index, "nosuch").count() == 0


def test_index_on_disk_follows_its_rows(spark, tmp_path):
    from docframe.operators.search import SearchIndex

    rows = [("a", "red red blue"), ("b", "blue"), ("c", "green")]
    df = spark.createDataFrame(rows, "path string, t string")
    index = SearchIndex(spark, tmp_path / "i")
    index.rebuild(df, "path", ["t"])
    found = lambda q: {r["key"] for r in index.search(q, limit=None).collect()}
    assert found("red") == {"a"} and found("blue") == {"a", "b"}
    changed = spark.createDataFrame([("b", "red"), ("d", "blue")], "path string, t string")
    index.update(changed, "path", ["t"], spark.createDataFrame([("c",)], "key string"))
    assert found("red") == {"a", "b"} and found("blue") == {"a", "d"} and found("green") == set()
    now = spark.createDataFrame([("a", "red red blue"), ("b", "red"), ("d", "blue")], "path string, t string")
    score = lambda d: {r["key"]: round(r["score"], 9) for r in d.collect()}
    assert score(index.search("red blue")) == score(search(now, "red blue", "path", ["t"]))
    plan = index.search("red", limit=None)._jdf.queryExecution().toString()
    assert "In(term, [red])" in plan or "EqualTo(term,red)" in plan
    assert "Sort" not in plan and "CollectLimit" not in plan


def test_terms_of_a_long_document_are_counted_in_linear_time(spark):
    import time

    df = spark.createDataFrame([("a", " ".join(f"w{i}" for i in range(60_000)))], "path string, t string")
    began = time.perf_counter()
    assert build_index(df, "path", ["t"]).count() == 60_000
    assert time.perf_counter() - began < 20


def test_value_index_does_not_grow_with_updates(spark, tmp_path):
    df = spark.createDataFrame([(str(i), i) for i in range(50)], "path string, n int")
    index = docframe.FieldIndex(df, "path", ["n"], tmp_path / "i")
    for k in range(4):
        index.update(spark.createDataFrame([("7", 1000 + k)], "path string, n int"))
    assert [r["key"] for r in index.compare("n", ">=", 1000).collect()] == ["7"] and index.values.count() == 50
    assert "Join" not in index.compare("n", "=", 3)._jdf.queryExecution().toString()
    again = docframe.FieldIndex(df, "path", ["n"], tmp_path / "i")
    assert [r["key"] for r in again.compare("n", "=", 1003).collect()] == ["7"]
    index.invalidate(spark.createDataFrame([("7",)], "key string"))
    assert index.compare("n", ">", 900).count() == 0


def test_table_search_follows_its_files(spark, shop, tmp_path):
    table = docframe.Table(shop / "orders", spark, snapshot=tmp_path / "snap")
    plain = docframe.Table(shop / "orders", spark)
    assert table.search("two") == plain.search("two") == ["second.md"]
    assert sorted(table.search("three code")) == sorted(plain.search("three code"))
    table.update("third", {"Summary": "now two as well"})
    table.delete("second")
    assert table.search("two") == ["third.md"] and table.search("three") == []
    assert table.search("go", "Go-Live Notes") == ["first.md"] and table.search("go", "nosuch") == []
