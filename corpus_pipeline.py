"""A training corpus from documents: quality, exact copies, near copies, mixture, packed sequences.

Each stage is one operator of docframe.llm over all that the stage before kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docframe.llm.exact_dedup import drop_exact_copies
from docframe.llm.mixing import mix_sources
from docframe.llm.near_copies import near_copy_keepers
from docframe.llm.packing import pack_documents
from docframe.llm.quality import UNKNOWN_LANG, quality_scores
from docframe.llm.queries import MIX_WEIGHTS, TOKENIZER
from docframe.llm.storage import new_path, remove, scratch, stored

#: Keys of rejected documents that are broadcast; more are joined.
BROADCAST_KEYS = 500_000


def _hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _first_of_each(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """rows whose (doc_id, text_hash) is in kept (distinct); where rows repeat both, one of them."""
    key = lambda c: F.coalesce(c.cast("long").cast("string"), F.lit(""))
    # the window has the join's key, so that texts are shuffled once for both
    mine = rows.withColumns({"__own": key(F.col("doc_id")), "__hash": _hash()})
    theirs = kept.select(key(F.col("doc_id")).alias("__id"), F.col("text_hash").alias("__text"))
    joined = mine.join(theirs, (F.col("__own") == F.col("__id")) & (F.col("__hash") == F.col("__text")))
    place = F.row_number().over(Window.partitionBy("__own", "__hash").orderBy(F.col("text").isNull()))
    return joined.withColumn("__row", place).where("__row = 1").select(*rows.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the quality model rejects go.

    Trusted text is that of labelled quality 1. Rows that share an id, or have none, are judged each by its own text.
    """
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    rejected = quality_scores(docs, trusted, hashed=True).where("not kept").select(
        F.col("doc_id").alias("__id"), F.col("lang").alias("__lang"), F.col("text_hash").alias("__text")
    ).distinct()
    rejected = stored(rejected, "rejected")
    # a null and an empty language are one to the model
    lang = F.nullif("lang", F.lit(UNKNOWN_LANG))
    same = (_hash() == F.col("__text")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & lang.eqNullSafe(F.col("__lang"))
    # where they are few, no text moves
    return docs.join(F.broadcast(rejected) if rejected.count() <= BROADCAST_KEYS else rejected, same, "left_anti")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of documents with equal texts, the one with the largest doc_id stays, in one row."""
    return drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest
    doc_id stays, in one row."""
    return _first_of_each(docs, near_copy_keepers(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents in as many rows as their source's rate says, in shuffled order.

    Sources without a target weight, null included, keep their share of the documents.
    """
    return mix_sources(docs, MIX_WEIGHTS, keep_other=True).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: all rows, cut to pieces of 2,048 tokens at most, packed into sequences."""
    return pack_documents(docs, TOKENIZER)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources", mix),
    ("best-fit packing", pack),
]

#: Perplexities, fingerprints and tokens are not expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again.

    What a stage stored on the way goes when its rows are written, and these go when the next stage is done.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: str | None = None
    for i, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage{i}")
        with scratch(spark):
            rows = stage(spark, docs, sf_dir)
            rows.write.parquet(path)
        docs = spark.read.schema(rows.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
