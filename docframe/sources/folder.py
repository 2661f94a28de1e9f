"""A folder of documents as a Spark table: files are read and parsed by tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docframe.functions.values import DECLARED
from docframe.sources.markdown import document_row, parse_document, validate_document
from docframe.sources.schema import SCHEMA_FILE, STAMPS, TableSchema

TEXT_MAP = T.MapType(T.StringType(), T.StringType())
PROBLEM = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("error_type", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("line_number", T.LongType()),
    ]
)
HIDDEN = ("_extra", "_sections")


def row_type(schema: TableSchema) -> T.StructType:
    """Columns of a table: path, declared fields, stamps, h1, declared sections, undeclared columns.

    What a schema demands of a column is in the column's metadata; all columns are nullable, as invalid
    documents are a separate output.
    """
    out = [T.StructField("path", T.StringType(), metadata={"kind": "path"})]
    for name, f in schema.fields.items():
        meta = {"kind": "frontmatter", "required": f.required} | ({"enum": [str(x) for x in f.enum]} if f.enum else {})
        out.append(T.StructField(name, DECLARED[f.type], metadata=meta))
    out += [T.StructField(s, T.TimestampNTZType(), metadata={"kind": "stamp"}) for s in STAMPS if s not in schema.fields]
    out.append(T.StructField("h1", T.StringType(), metadata={"kind": "h1"}))
    for name, s in schema.sections.items():
        out.append(T.StructField(name, T.StringType(), metadata={"kind": "section", "content_type": s.type, "required": s.required}))
    seen: dict[str, T.StructField] = {}
    for f in out:  # a section takes the place of a field of its name
        seen[f.name] = f
    return T.StructType([*seen.values(), *(T.StructField(h, TEXT_MAP) for h in HIDDEN)])


def _parser(schema: TableSchema, arrow: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    maps = [f.name for f in arrow if pa.types.is_map(f.type)]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content, changed in zip(b["path"].to_pylist(), b["content"].to_pylist(), b["changed"].to_pylist(), strict=True):
                doc = parse_document(content.decode("utf-8", "replace"), path, schema.normalize_numbered_headings)
                problems = validate_document(doc, schema)
                row = {"path": path} if problems else document_row(doc, schema)
                for m in maps:
                    row[m] = list(row[m].items()) if row.get(m) is not None else None
                rows.append(row | {"_changed": changed, "_errors": [p.__dict__ for p in problems]})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return parse


def parsed_type(schema: TableSchema) -> T.StructType:
    return T.StructType(
        [*row_type(schema).fields, T.StructField("_changed", T.TimestampNTZType()), T.StructField("_errors", T.ArrayType(PROBLEM))]
    )


def parse_files(files: DataFrame, schema: TableSchema) -> DataFrame:
    """Parses documents given as rows (path, content binary, changed timestamp_ntz), where they are."""
    full = parsed_type(schema)
    return files.select("path", "content", "changed").mapInArrow(_parser(schema, to_arrow_schema(full)), full)


def scan_folder(spark: SparkSession, folder: str | Path, schema: TableSchema, names: Iterable[str] | None = None) -> DataFrame:
    """Every document of a folder, parsed: its columns, _changed (when the file changed) and _errors.

    names: only these files are opened, as for a query that asks for some paths.
    """
    where = [f"{folder}/{n}" for n in names] if names is not None else str(folder)
    if where == []:
        return spark.createDataFrame([], parsed_type(schema))
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(where)
        .where(F.col("_metadata.file_name") != SCHEMA_FILE)
        .select(F.col("_metadata.file_name").alias("path"), "content", F.col("modificationTime").cast("timestamp_ntz").alias("changed"))
    )
    # Spark packs few small files to a task; with more tasks than slots, each takes up to 16 such packs
    packs = files.rdd.getNumPartitions()
    tasks = max(spark.sparkContext.defaultParallelism, -(-packs // 16))
    return parse_files(files.coalesce(tasks) if tasks < packs else files, schema)


def valid_rows(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.size("_errors") == 0).drop("_errors", "_changed")


def problems(parsed: DataFrame) -> DataFrame:
    """One row for each way in which a document breaks the schema."""
    return parsed.select(F.explode("_errors").alias("e")).select("e.*")
