"""Full-text search: an inverted table of terms, scored by BM25."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.plans.binder import quoted
from docframe.sources.snapshot import Versions

#: The usual constants of BM25, the longest term in bytes, the most results.
K1, B = 1.2, 0.75
TERM_BYTES = 40
RESULTS = 10_000


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits of at most TERM_BYTES bytes."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: (w != "") & (F.octet_length(w) <= TERM_BYTES))


def _is(term: str) -> Callable[[Column], Column]:
    return lambda t: t == F.lit(term)


def build_index(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows (key, field, length, term, n): how often each term is in each text column of a row."""
    texts = F.array(*[F.struct(F.lit(c).alias("field"), terms(F.coalesce(F.col(quoted(c)), F.lit(""))).alias("terms")) for c in columns])
    fields = df.select(F.col(quoted(key)).alias("key"), F.explode(texts).alias("f"))
    each = fields.select("key", "f.field", F.size("f.terms").alias("length"), F.explode("f.terms").alias("term"))
    return each.groupBy("key", "field", "length", "term").agg(F.count(F.lit(1)).cast("int").alias("n"))


def index_totals(index: DataFrame) -> DataFrame:
    """(field, rows, length): how many texts each field has, and how many terms in all."""
    texts = index.select("key", "field", "length").distinct()
    return texts.groupBy("field").agg(F.count(F.lit(1)).alias("rows"), F.sum("length").alias("length"))


class SearchIndex:
    """An index on disk: its terms, sorted by term so that a search reads those of its query, and its totals.

    `rebuild` writes it from all rows; `update` takes new and changed rows in and others out without reading the
    texts of the rest. A version becomes current by renaming its manifest, so that readers see a whole one.
    """

    def __init__(self, spark: SparkSession, place: str | Path) -> None:
        self.versions = Versions(spark, place)

    def _write(self, index: DataFrame, note: dict | None) -> None:
        ordered = index.repartitionByRange("term").sortWithinPartitions("term", "field", "key")

        def write(target: str) -> None:
            ordered.write.parquet(f"{target}/terms")
            index_totals(index.sparkSession.read.parquet(f"{target}/terms")).coalesce(1).write.parquet(f"{target}/totals")

        self.versions.replace(write, note)

    def rebuild(self, df: DataFrame, key: str, columns: Sequence[str], note: dict | None = None) -> None:
        self._write(build_index(df, key, columns), note)

    def update(self, df: DataFrame, key: str, columns: Sequence[str], gone: DataFrame | None = None, note: dict | None = None) -> None:
        """df: new and changed rows; gone: a table with the column key of rows that are no more."""
        out = df.select(F.col(quoted(key)).alias("key"))
        out = out.union(gone.select("key")) if gone is not None else out
        kept = self.versions.read("terms").join(out.distinct(), "key", "left_anti")
        self._write(kept.unionByName(build_index(df, key, columns)), note)

    def search(self, query: str, field: str | None = None, limit: int | None = RESULTS) -> DataFrame:
        return search_index(self.versions.read("terms"), query, field, limit, self.versions.read("totals"))


def search(df: DataFrame, query: str, key: str, columns: Sequence[str], field: str | None = None, limit: int | None = RESULTS) -> DataFrame:
    """Rows (key, score) that hold any term of the query, best first, at most `limit`; without a limit in no order.

    field: one of the columns; an unknown one finds nothing. Without it, a row's columns count as one
    text. Only rows with a term of the query leave the scan.
    """
    spark = df.sparkSession
    wanted = [r[0] for r in spark.range(1).select(F.explode(F.array_distinct(terms(F.lit(query))))).collect()]
    used = [c for c in columns if field in (None, c)]
    if not wanted or not used:
        return spark.createDataFrame([], "key string, score double").limit(0)
    text = F.concat_ws("\n", *[F.col(quoted(c)) for c in used])
    rows = df.select(F.col(quoted(key)).cast("string").alias("key"), terms(text).alias("terms"))
    counts = [F.size(F.filter("terms", _is(w))).cast("double").alias(f"n{i}") for i, w in enumerate(wanted)]
    held = rows.select("key", F.size("terms").cast("double").alias("length"), *counts)
    # one row of totals comes to the driver, so that the score is arithmetic on literals
    totals = held.agg(
        F.count(F.lit(1)).alias("rows"), F.avg("length").alias("mean"), *[F.sum((F.col(f"n{i}") > 0).cast("long")).alias(f"d{i}") for i in range(len(wanted))]
    ).first()
    found = held.where(" or ".join(f"n{i} > 0" for i in range(len(wanted))))
    score = F.lit(0.0)
    for i in range(len(wanted)):
        score = score + _weight(totals["rows"], totals[f"d{i}"] or 0) * _saturation(F.col(f"n{i}"), F.col("length"), totals["mean"] or 1.0)
    return _best(found.select("key", score.alias("score")), limit)


def _best(scored: DataFrame, limit: int | None) -> DataFrame:
    return scored if limit is None else scored.orderBy(F.desc("score"), "key").limit(limit)


def _weight(rows: int, having: int) -> float:
    return math.log(1 + (rows - having + 0.5) / (having + 0.5))


def _saturation(n: Column, length: Column, mean: float) -> Column:
    return n * (K1 + 1) / (n + K1 * (1 - B + B * length / F.lit(float(mean) or 1.0)))


def search_index(index: DataFrame, query: str, field: str | None = None, limit: int | None = RESULTS, totals: DataFrame | None = None) -> DataFrame:
    """The same search over a written index: of it only the query's terms are read.

    totals: what index_totals gives, stored with the index; without it they are counted, which reads the whole index.
    A row's fields count as texts of their own, and its score is their sum.
    """
    spark = index.sparkSession
    wanted = [r[0] for r in spark.range(1).select(F.explode(F.array_distinct(terms(F.lit(query))))).collect()]
    if not wanted:
        return spark.createDataFrame([], "key string, score double")
    of_field = F.col("field") == field if field else F.lit(True)
    texts = (totals if totals is not None else index_totals(index)).where(of_field).agg(F.sum("rows").alias("rows"), F.sum("length").alias("length")).first()
    hits = index.where(of_field & F.col("term").isin(wanted))
    having = {r["term"]: r["count"] for r in hits.groupBy("term").count().collect()}  # as many as the query has terms
    if not having:
        return spark.createDataFrame([], "key string, score double")
    weight = F.create_map(*[F.lit(x) for t, d in having.items() for x in (t, _weight(texts["rows"], d))])[F.col("term")]
    score = weight * _saturation(F.col("n").cast("double"), F.col("length").cast("double"), texts["length"] / texts["rows"])
    return _best(hits.groupBy(F.col("key").cast("string").alias("key")).agg(F.sum(score).alias("score")), limit)
