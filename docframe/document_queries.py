"""Registered queries that are more than a statement: documents, keys, search and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.operators.foreign_keys import check_foreign_keys, key_violations
from docframe.operators.search import search
from docframe.plans.binder import Binder, Table
from docframe.plans.parser import parse
from docframe.queries import tables
from docframe.sources.folder import HIDDEN, parse_files, problems, valid_rows
from docframe.sources.schema import FieldSpec, ForeignKey, SectionSpec, TableSchema
from docframe.streaming.watch import stream_violations

#: A schema for orders as documents: most declared types, with sections.
ORDER_SCHEMA = TableSchema(
    "orders",
    {
        "key": FieldSpec("int", True),
        "customer": FieldSpec("int", True),
        "status": FieldSpec("string", True, ("F", "O", "P")),
        "price": FieldSpec("float"),
        "day": FieldSpec("date", True),
        "at": FieldSpec("datetime"),
        "open": FieldSpec("bool"),
        "tags": FieldSpec("string[]"),
    },
    {"Summary": SectionSpec(required=True), "Notes": SectionSpec()},
    h1_field="key",
)


def _changed() -> Column:
    return F.lit("2024-01-01").cast("timestamp_ntz").alias("changed")


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _order_files(spark: SparkSession, sf_dir: str, defects: bool) -> DataFrame:
    """Orders as documents; with defects, each key modulo 10 breaks its document in its own way.

    A small Parquet file is one task, however long its documents take to parse: they are dealt out first.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").repartition(spark.sparkContext.defaultParallelism)
    kind = F.col("o_orderkey") % 10

    def broken(k: int, good: Column, bad: str) -> Column:
        return F.when(kind == k, F.lit(bad)).otherwise(good) if defects else good

    lit = F.lit
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    body = _text(
        broken(0, lit("---\n"), "--\n"),
        "key: ", F.col("o_orderkey"), "\n",
        broken(1, _text("customer: ", F.col("o_custkey"), "\n"), ""),
        "status: ", broken(2, _text('"', F.col("o_orderstatus"), '"'), '"X"'), "\n",
        "price: ", broken(3, F.format_string("%.2f", "o_totalprice"), '"dear"'), "\n",
        "day: ", day, "\n", "at: ", day, "T10:20:30\n",
        "open: ", (F.col("o_orderstatus") == "O"), "\n",
        'tags:\n  - "', F.lower("o_orderpriority"), '"\n  - all\n',
        broken(4, lit(""), "colour: red\n"),
        "---\n\n",
        broken(5, _text("# ", F.col("o_orderkey"), "\n"), "# other\n"),
        broken(6, lit("\n## Summary\n\nAn order.\n```\n## not a section\n```\n"), "\n## Overview\n\nAn order.\n"),
        broken(7, lit(""), "\n## Summary\n\nAgain.\n"),
        "\n## Notes\n\nFrom ", F.col("o_custkey"), ".\n",
    )
    return orders.select(_text(F.col("o_orderkey"), ".md").alias("path"), body.cast("binary").alias("content"), _changed())


def md_roundtrip_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = valid_rows(parse_files(_order_files(spark, sf_dir, False), ORDER_SCHEMA))
    table = Table(rows, "path", HIDDEN, HIDDEN)
    found = Binder(lambda _: table).select(parse("SELECT path, key, customer, status, price, `day`, at, open, tags, h1, Summary, Notes FROM orders"))
    return found.withColumn("tags", F.array_join("tags", "|")).withColumn("day", F.col("day").cast("string"))


MD_ROUNDTRIP_SQL = """
SELECT o_orderkey || '.md' AS path, o_orderkey AS key, o_custkey AS customer, o_orderstatus AS status, printf('%.2f', o_totalprice)::DOUBLE AS price,
       o_orderdate::DATE::VARCHAR AS day, o_orderdate::DATE + INTERVAL '10 hours 20 minutes 30 seconds' AS at, o_orderstatus = 'O' AS open,
       lower(o_orderpriority) || '|all' AS tags, o_orderkey::VARCHAR AS h1,
       'An order.' || chr(10) || '```' || chr(10) || '## not a section' || chr(10) || '```' AS Summary, 'From ' || o_custkey || '.' AS Notes
FROM orders
"""


def md_validation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = problems(parse_files(_order_files(spark, sf_dir, True), ORDER_SCHEMA))
    return found.groupBy("error_type", "field").agg(F.count(F.lit(1)).alias("n"))


MD_VALIDATION_SQL = """
SELECT error_type, field, count(*) AS n FROM orders JOIN (VALUES
  (0, 'parse_error', NULL), (1, 'missing_field', 'customer'), (2, 'enum_violation', 'status'), (3, 'type_mismatch', 'price'),
  (4, 'unknown_field', 'colour'), (5, 'h1_mismatch', 'key'), (6, 'missing_section', 'Summary'), (6, 'unknown_section', 'Overview'),
  (7, 'duplicate_section', 'Summary')) t(k, error_type, field) ON o_orderkey % 10 = k
GROUP BY ALL
"""


def md_section_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents with a section for each turn, queried by undeclared section names."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    # one line for each turn, so that no text is taken for a heading
    line = _text("## Turn ", F.col("turn"), "\n\n", F.col("role"), ": ", F.regexp_replace("text", r"\s+", " "), "\n")
    ordered = F.array_sort(F.collect_list(F.struct("turn", line.alias("t"))))
    docs = turns.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n").alias("t"))
    files = docs.select(
        _text(F.col("conv_id"), ".md").alias("path"),
        _text("---\nconv: ", F.col("conv_id"), "\n---\n\n", F.col("t")).cast("binary").alias("content"),
        _changed(),
    )
    schema = TableSchema("conversations", {"conv": FieldSpec("int", True)}, h1_required=False, reject_unknown_sections=False, reject_duplicate_sections=False)
    table = Table(valid_rows(parse_files(files, schema)), "path", HIDDEN, HIDDEN)
    sql = "SELECT conv, `Turn 0` AS first FROM conversations WHERE `Turn 0` LIKE 'user: %' AND `Turn 1` IS NOT NULL"
    return Binder(lambda _: table).select(parse(sql))


MD_SECTION_SQL = r"""
WITH last AS (SELECT conv_id, turn, arg_max(role || ': ' || regexp_replace(text, '\s+', ' ', 'g'), role || ': ' || text) AS t FROM conversations GROUP BY ALL)
SELECT conv_id AS conv, trim(t) AS first FROM last a
WHERE turn = 0 AND t ILIKE 'user: %' AND EXISTS (SELECT 1 FROM last b WHERE b.conv_id = a.conv_id AND b.turn = 1)
"""


def fk_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [ForeignKey("documents", "doc_id", "labels", "doc_id"), ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey")]
    return check_foreign_keys(spark, keys, tables(spark, sf_dir), "doc_id").select("file_path", "error_type", "field", "message")


FK_SQL = """
SELECT 'documents/' || doc_id AS file_path, 'fk_violation' AS error_type, 'doc_id' AS field,
       'doc_id = ''' || doc_id || ''' not found in labels.doc_id' AS message
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
"""


def fk_list_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    child = tables(spark, sf_dir)("user_types").df
    parent = spark.sql("SELECT explode(array('click', 'view')) AS name")
    found = key_violations(child, parent, ForeignKey("user_types", "types", "kinds", "name"), "user_id")
    return found.groupBy("message").agg(F.count(F.lit(1)).alias("n"))


FK_LIST_SQL = """
SELECT 'types = ''' || event_type || ''' not found in kinds.name' AS message, count(DISTINCT user_id) AS n
FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY event_type
"""


def stream_fk_available_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").schema
    # as a pattern, the path may be a file or a folder
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parque[t]")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = stream_violations(stream, labels, ForeignKey("documents", "doc_id", "labels", "doc_id"), "doc_id")
    return found.select("file_path", "error_type", "field", "message")


def _search(query: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        found = search(docs, query, "doc_id", ["text"], limit=None)
        return found.select(F.col("key").cast("bigint").alias("doc_id"), F.round("score", 6).alias("score"))

    return run


def _search_sql(words: list[str]) -> str:
    counts = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS n{i}" for i, w in enumerate(words))
    sums = ", ".join(f"sum((n{i} > 0)::INT) AS d{i}" for i in range(len(words)))
    score = " + ".join(f"ln(1 + (n_rows - d{i} + 0.5) / (d{i} + 0.5)) * n{i} * 2.2 / (n{i} + 1.2 * (0.25 + 0.75 * len / mean))" for i in range(len(words)))
    return (
        r"WITH terms AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '' AND octet_length(encode(x)) <= 40) AS t FROM documents), "
        f"held AS (SELECT doc_id, len(t)::DOUBLE AS len, {counts} FROM terms), "
        f"stats AS (SELECT count(*)::DOUBLE AS n_rows, avg(len) AS mean, {sums} FROM held) "
        f"SELECT doc_id, round({score}, 6) AS score FROM held, stats WHERE {' OR '.join(f'n{i} > 0' for i in range(len(words)))}"
    )


#: name: (function, DuckDB SQL)
OPERATORS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "md_roundtrip_orders": (md_roundtrip_orders, MD_ROUNDTRIP_SQL),
    "md_validation_errors": (md_validation_errors, MD_VALIDATION_SQL),
    "md_section_query": (md_section_query, MD_SECTION_SQL),
    "fk_violations": (fk_violations, FK_SQL),
    "fk_list_column": (fk_list_column, FK_LIST_SQL),
    "stream_fk_available_now": (stream_fk_available_now, FK_SQL),
    "fts_term": (_search("license"), _search_sql(["license"])),
    "fts_two_terms": (_search("Apache, 2025!"), _search_sql(["apache", "2025"])),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in OPERATORS.items()}
