"""Registered queries over document folders: each writes a folder from a table, works on it, and reads it back."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.errors import DocframeError
from docframe.operators.catalog import Database, Table
from docframe.operators.field_index import FieldIndex
from docframe.operators.foreign_keys import check_foreign_keys
from docframe.operators.search import SearchIndex
from docframe.queries import tables
from docframe.sources import schema as sch
from docframe.sources.folder import parse_files, problems
from docframe.sources.schema import FieldSpec, ForeignKey, SectionSpec, TableSchema

NATIONS = TableSchema(
    "nations",
    {"title": FieldSpec("string", True), "number": FieldSpec("int", True), "region": FieldSpec("string"), "tags": FieldSpec("string[]"), "kind": FieldSpec("string", False, ("old", "new"))},
    {"Summary": SectionSpec(required=True), "Notes": SectionSpec(), "Remarks": SectionSpec()},
    h1_field="title",
)
REGIONS = TableSchema("regions", {"title": FieldSpec("string", True), "number": FieldSpec("int", True)}, h1_required=False)
KEY = ForeignKey("nations", "region", "regions", "path")


def work_folder(spark: SparkSession) -> Path:
    """A new folder of documents, below the shared folder where that is a file system's; gone when Python ends."""
    named = urlparse(spark.sparkContext.getConf().get("spark.checkpoint.dir") or "")
    below = named.path if named.scheme in ("", "file") and named.path else None
    if below:
        Path(below).mkdir(parents=True, exist_ok=True)
    elif not spark.sparkContext.master.startswith("local"):
        raise DocframeError("Folders of documents need a spark.checkpoint.dir that is a mounted folder")
    place = Path(tempfile.mkdtemp(prefix="docframe-", dir=below))
    atexit.register(shutil.rmtree, place, ignore_errors=True)
    return place


def _nations(spark: SparkSession, sf_dir: str) -> list:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()


def _database(spark: SparkSession, sf_dir: str, snapshots: bool = False) -> Database:
    """Nations and regions as a database of documents, written by inserts."""
    root = work_folder(spark)
    place = root / "geo"
    for name, schema in (("nations", NATIONS), ("regions", REGIONS)):
        (place / name).mkdir(parents=True)
        (place / name / sch.SCHEMA_FILE).write_text(sch.schema_text(schema))
    (place / sch.SCHEMA_FILE).write_text(sch.config_text(sch.DatabaseConfig("geo", (KEY,))))
    db = Database(place, spark, root / "snapshots" if snapshots else None)
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").collect()
    for r in regions:
        db.table("regions").insert({"title": r["r_name"], "number": r["r_regionkey"]}, filename=f"r{r['r_regionkey']}")
    nations = db.table("nations")
    for r in _nations(spark, sf_dir):
        k = r["n_nationkey"]
        body = f"# {r['n_name']}\n\n## Summary\n\nNation {k} of r{r['n_regionkey']}.\n\n## Notes\n\nnote {k}\n\n## Remarks\n\nremark {k}\n"
        nations.insert({"title": r["n_name"], "number": k, "region": f"r{r['n_regionkey']}.md", "tags": ["all", f"t{k % 3}"], "kind": "old"}, body, filename=f"n{k}")
    return db


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("tags", F.array_join("tags", "|")) if "tags" in df.columns else df


ALL = "SELECT path, title, number, region, tags, kind, Summary, Notes, Remarks, h1 FROM nations"
#: The same of the table: what a step changes is put in place of the default.
NATION_COLUMNS = {
    "path": "'n' || n_nationkey || '.md'",
    "title": "n_name",
    "number": "n_nationkey::BIGINT",
    "region": "'r' || n_regionkey || '.md'",
    "tags": "'all|t' || n_nationkey % 3",
    "kind": "'old'",
    "Summary": "'Nation ' || n_nationkey || ' of r' || n_regionkey || '.'",
    "Notes": "'note ' || n_nationkey",
    "Remarks": "'remark ' || n_nationkey",
    "h1": "n_name",
}


def _nation_sql(where: str = "true", drop: tuple[str, ...] = (), **changes: str) -> str:
    columns = {k: x for k, x in (NATION_COLUMNS | changes).items() if k not in drop}
    return f"SELECT {', '.join(f'{x} AS {k}' for k, x in columns.items())} FROM nation WHERE {where}"


def folder_insert_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_database(spark, sf_dir).sql(ALL))


def folder_update_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _database(spark, sf_dir)
    db.execute("UPDATE nations SET kind = 'new', Notes = 'changed' WHERE region = 'r1.md'")
    db.execute("UPDATE nations SET tags = 'a, b' WHERE number > 20 AND number < 23")
    db.execute("DELETE FROM nations WHERE region = 'r2.md'")
    db.table("nations").delete("n0")
    return _flat(db.sql(ALL))


UPDATE_SQL = _nation_sql(
    "n_regionkey <> 2 AND n_nationkey <> 0",
    kind="CASE WHEN n_regionkey = 1 THEN 'new' ELSE 'old' END",
    Notes="CASE WHEN n_regionkey = 1 THEN 'changed' ELSE 'note ' || n_nationkey END",
    tags="CASE WHEN n_nationkey IN (21, 22) THEN 'a|b' ELSE 'all|t' || n_nationkey % 3 END",
)


def folder_insert_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INSERT as a statement; the file's name comes from the title."""
    db = _database(spark, sf_dir)
    db.execute("INSERT INTO regions (title, number) VALUES ('Far Away!', 77)")
    return db.sql("SELECT path, title, number FROM regions")


INSERT_SQL = "SELECT 'r' || r_regionkey || '.md' AS path, r_name AS title, r_regionkey::BIGINT AS number FROM region UNION ALL SELECT 'far-away.md', 'Far Away!', 77"


def folder_failed_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement that would make a document invalid changes none."""
    db = _database(spark, sf_dir)
    with contextlib.suppress(DocframeError):
        db.execute("UPDATE nations SET kind = 'wrong' WHERE number > 3")
    return _flat(db.sql(ALL))


def folder_rename_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _database(spark, sf_dir)
    db.execute("ALTER TABLE nations RENAME FIELD kind TO sort")
    db.execute("ALTER TABLE nations RENAME FIELD Notes TO Hints")
    db.reload()
    return _flat(db.sql("SELECT path, title, number, region, tags, sort, Summary, Hints, Remarks, h1 FROM nations"))


def folder_drop_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _database(spark, sf_dir)
    db.execute("ALTER TABLE nations DROP FIELD kind")
    db.execute("ALTER TABLE nations DROP FIELD Remarks")
    db.reload()
    return _flat(db.sql("SELECT * FROM nations")).drop("created", "modified")


def folder_merge_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _database(spark, sf_dir)
    db.execute("ALTER TABLE nations MERGE FIELDS Notes, Remarks INTO Both")
    db.reload()
    found = db.sql("SELECT path, `Both` AS merged FROM nations")
    return found.withColumn("merged", F.regexp_replace("merged", r"\s+", " "))


MERGE_SQL = "SELECT 'n' || n_nationkey || '.md' AS path, 'note ' || n_nationkey || ' remark ' || n_nationkey AS merged FROM nation"


def folder_rename_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A renamed document takes the foreign keys to it along."""
    db = _database(spark, sf_dir)
    db.rename("regions", "r1", "first")
    return db.sql("SELECT n.path AS path, r.path AS region, r.title AS title FROM nations n JOIN regions r ON n.region = r.path")


RENAME_SQL = """
SELECT 'n' || n_nationkey || '.md' AS path, CASE WHEN r_regionkey = 1 THEN 'first.md' ELSE 'r' || r_regionkey || '.md' END AS region, r_name AS title
FROM nation JOIN region ON n_regionkey = r_regionkey
"""


def folder_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _database(spark, sf_dir)
    db.table("nations").stamp()
    found = "SELECT COUNT(*) AS n, COUNT(created) AS c, COUNT(modified) AS m, MIN(DATEDIFF(CURRENT_TIMESTAMP, created)) AS age FROM nations WHERE created <= modified"
    return db.sql(found)


def folder_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views made and dropped by statements, one with column names and one on it, read after a reload."""
    db = _database(spark, sf_dir)
    db.execute("CREATE VIEW pairs (nation, area) AS SELECT n.title, r.title FROM nations n JOIN regions r ON n.region = r.path")
    db.execute("CREATE VIEW some AS SELECT nation FROM pairs WHERE area = 'ASIA'")
    db.execute("CREATE VIEW gone AS SELECT title FROM regions")
    db.execute("DROP VIEW gone")
    again = Database(db.path, spark)
    assert again.view_names == ["pairs", "some"]
    return again.sql("SELECT p.nation AS nation, p.area AS area FROM pairs p JOIN some s ON p.nation = s.nation")


VIEWS_SQL = "SELECT n_name AS nation, r_name AS area FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"


def folder_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows from a Parquet snapshot, of which changed files alone are parsed again."""
    db = _database(spark, sf_dir, snapshots=True)
    db.sql(ALL).count()
    db.execute("UPDATE nations SET kind = 'new' WHERE number = 7")
    db.table("nations").delete("n8")
    return _flat(db.sql(ALL))


def folder_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All problems of a database: documents, keys and views."""
    db = _database(spark, sf_dir)
    place = db.path / "nations"
    for path in sorted(place.glob("n1*.md")):
        text = path.read_text()
        path.write_text(re.sub("^created: .*$", "created: yesterday", text, flags=re.MULTILINE))
    (db.path / "regions" / "r4.md").unlink()
    config = db.config
    (db.path / sch.SCHEMA_FILE).write_text(
        sch.config_text(sch.DatabaseConfig("geo", (*config.foreign_keys, ForeignKey("nations", "title", "cities", "path")), (sch.View("bad", "SELECT a FROM nowhere"),)))
    )
    found = Database(db.path, spark).validate()
    rows = spark.createDataFrame([(p.file_path, p.error_type, p.field) for p in found], "file_path string, error_type string, field string")
    return rows.groupBy("error_type", "field").agg(F.count(F.lit(1)).alias("n"))


VALIDATE_SQL = """
WITH docs AS (SELECT *, n_nationkey::VARCHAR LIKE '1%' AS bad FROM nation)
SELECT 'type_mismatch' AS error_type, 'created' AS field, count(*) AS n FROM docs WHERE bad
UNION ALL SELECT 'fk_violation', 'region', count(*) FROM docs WHERE NOT bad AND n_regionkey = 4
UNION ALL SELECT 'fk_missing_table', 'title', 1 UNION ALL SELECT 'view_error', NULL, 1
"""


def fk_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys without a violation: no rows is the right result."""
    keys = [ForeignKey("nation", "n_regionkey", "region", "r_regionkey"), ForeignKey("orders", "o_custkey", "customer", "c_custkey")]
    return check_foreign_keys(spark, keys, tables(spark, sf_dir), "path").select("file_path", "error_type", "field", "message")


FK_CLEAN_SQL = """
SELECT NULL::VARCHAR AS file_path, NULL::VARCHAR AS error_type, NULL::VARCHAR AS field, NULL::VARCHAR AS message
FROM nation, orders WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region) AND o_custkey NOT IN (SELECT c_custkey FROM customer)
"""


def md_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered headings, and documents without a first-level heading or with a bad stamp."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    kind = F.col("o_orderkey") % 4
    heading = F.when(kind == 1, "").otherwise("# order\n\n")
    stamp = F.when(kind == 2, "created: soon\n").otherwise("")
    text = F.concat(F.lit("---\nkey: "), F.col("o_orderkey").cast("string"), F.lit("\n"), stamp, F.lit("---\n\n"), heading, F.lit("## 1. Summary\n\nx\n"))
    schema = TableSchema("o", {"key": FieldSpec("int", True)}, {"Summary": SectionSpec(required=True)}, normalize_numbered_headings=True)
    files = orders.select(F.concat(F.col("o_orderkey").cast("string"), F.lit(".md")).alias("path"), text.cast("binary").alias("content"), F.lit("2024-01-01").cast("timestamp_ntz").alias("changed"))
    found = problems(parse_files(files.repartition(spark.sparkContext.defaultParallelism), schema))
    return found.groupBy("error_type", "field").agg(F.countDistinct("file_path").alias("n"))


MD_HEADINGS_SQL = """
SELECT error_type, field, count(*) AS n FROM orders JOIN (VALUES (1, 'missing_h1', NULL), (2, 'type_mismatch', 'created')) t(k, error_type, field) ON o_orderkey % 4 = k GROUP BY ALL
"""


def fts_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search over a written index that was built for other texts and then brought up to date."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = SearchIndex(spark, work_folder(spark) / "index")
    index.rebuild(docs.withColumn("text", F.lit("old license")), "doc_id", ["text"])
    index.update(docs, "doc_id", ["text"])
    found = index.search("Apache, 2025!", limit=None)
    return found.select(F.col("key").cast("bigint").alias("doc_id"), F.round("score", 6).alias("score"))


FTS_SQL = r"""
WITH terms AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '' AND octet_length(encode(x)) <= 40) AS t FROM documents),
held AS (SELECT doc_id, len(t)::DOUBLE AS len, len(list_filter(t, lambda x: x = 'apache')) AS n0, len(list_filter(t, lambda x: x = '2025')) AS n1 FROM terms WHERE len(t) > 0),
stats AS (SELECT count(*)::DOUBLE AS n_rows, avg(len) AS mean, sum((n0 > 0)::INT) AS d0, sum((n1 > 0)::INT) AS d1 FROM held)
SELECT doc_id, round(ln(1 + (n_rows - d0 + 0.5) / (d0 + 0.5)) * n0 * 2.2 / (n0 + 1.2 * (0.25 + 0.75 * len / mean))
                   + ln(1 + (n_rows - d1 + 0.5) / (d1 + 0.5)) * n1 * 2.2 / (n1 + 1.2 * (0.25 + 0.75 * len / mean)), 6) AS score
FROM held, stats WHERE n0 > 0 OR n1 > 0
"""


def idx_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-ups by value in a written index, combined like sets, after an update of its rows."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    columns = ["o_orderstatus", "o_totalprice", "o_custkey"]
    index = FieldIndex(orders.withColumn("o_totalprice", F.lit(1.0)), "o_orderkey", columns, work_folder(spark) / "index")
    index.update(orders)
    dear = index.between("o_totalprice", 300000, 400000)
    open_or_done = index.one_of("o_orderstatus", ["O", "F"])
    found = index.either(index.both(dear, open_or_done), index.compare("o_custkey", "<", 5))
    return found.select(F.col("key").alias("o_orderkey"))


IDX_SQL = "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 300000 AND 400000 AND o_orderstatus IN ('O', 'F') OR o_custkey < 5"

#: name: (function, DuckDB SQL)
OPERATORS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "folder_insert_scan": (folder_insert_scan, _nation_sql()),
    "folder_insert_statement": (folder_insert_statement, INSERT_SQL),
    "folder_update_delete": (folder_update_delete, UPDATE_SQL),
    "folder_failed_update": (folder_failed_update, _nation_sql()),
    "folder_rename_field": (folder_rename_field, _nation_sql(drop=("kind", "Notes"), sort="'old'", Hints="'note ' || n_nationkey")),
    "folder_drop_field": (folder_drop_field, _nation_sql(drop=("kind", "Remarks"))),
    "folder_merge_fields": (folder_merge_fields, MERGE_SQL),
    "folder_rename_document": (folder_rename_document, RENAME_SQL),
    "folder_stamps": (folder_stamps, "SELECT count(*) AS n, count(*) AS c, count(*) AS m, 0::BIGINT AS age FROM nation"),
    "folder_views": (folder_views, VIEWS_SQL),
    "folder_snapshot": (folder_snapshot, _nation_sql("n_nationkey <> 8", kind="CASE WHEN n_nationkey = 7 THEN 'new' ELSE 'old' END")),
    "folder_validate": (folder_validate, VALIDATE_SQL),
    "fk_clean": (fk_clean, FK_CLEAN_SQL),
    "md_headings": (md_headings, MD_HEADINGS_SQL),
    "fts_index": (fts_index, FTS_SQL),
    "idx_lookup": (idx_lookup, IDX_SQL),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in OPERATORS.items()}
