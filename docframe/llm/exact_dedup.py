"""Exact duplicates through an extendible-hash index on shared files (DataFrame operations only)."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docframe.llm.storage import stored

#: Index entries (distinct texts) of one bucket before it is split, where the directory is not at its largest.
BUCKET_CAPACITY = 256
#: Doublings of the directory at most; a slot is a small integer in the plan.
MAX_DEPTH = 16
#: Hashes with several rows that are broadcast to find their texts; more are joined.
BROADCAST_HASHES = 1_000_000


def split_directory(counts: dict[int, int], depth: int, capacity: int) -> list[int]:
    """Bucket of each of the 2**depth slots, from the entries in each slot.

    The directory starts with one bucket of depth 0. An overfull bucket is split in two by its next hash
    bit; where it already uses all the directory's bits, the directory doubles. Buckets are numbered in
    the order of their hash ranges.
    """
    held = [[counts.get(s, 0) for s in range(1 << depth)]]
    while len(held[-1]) > 1:
        held.append([a + b for a, b in zip(held[-1][::2], held[-1][1::2], strict=True)])
    slots: list[int] = []
    bucket = 0

    def split(prefix: int, local: int) -> None:
        nonlocal bucket
        width = depth - local
        if held[width][prefix] > capacity and width:
            split(prefix << 1, local + 1)
            split((prefix << 1) | 1, local + 1)
        else:
            slots.extend([bucket] * (1 << width))
            bucket += 1

    split(0, 0)
    return slots


def directory(entries: DataFrame, capacity: int = BUCKET_CAPACITY, max_depth: int = MAX_DEPTH) -> tuple[int, list[int]]:
    """(depth, slots) for entries with a 64-bit hash column h. Only counts by hash prefix come to the driver.

    Buckets hold `capacity` entries, or a share of 2**(1 - max_depth) of all entries where that is more, so that
    a directory of max_depth doublings is enough at any size; a slot that is still overfull has longer chains.
    """
    n = entries.count()
    capacity = max(capacity, math.ceil(2 * n / (1 << max_depth)))
    depth = min(max_depth, max(0, math.ceil(math.log2(max(n, 1) / capacity))))
    while True:
        counts = {r[0]: r[1] for r in entries.groupBy(_slot(depth).alias("slot")).count().collect()}
        if depth == max_depth or max(counts.values(), default=0) <= capacity:
            return depth, split_directory(counts, depth, capacity)
        depth += 1


def _slot(depth: int) -> Column:
    return F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")


def bucket_of(depth: int, slots: list[int]) -> Column:
    """The bucket that the directory gives for the hash column h."""
    lookup = F.from_json(F.lit(json.dumps(slots)), "array<int>")
    return F.element_at(lookup, _slot(depth).cast("int") + 1)


def _candidate_texts(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows (h, sha, text, doc_id) whose hash is that of another row too."""
    shared = stored(entries.groupBy("h").agg(F.sum("rows").alias("n")).where("n > 1").select("h"), "shared-hashes")
    if shared.count() <= BROADCAST_HASHES:
        return rows.join(F.broadcast(shared), "h", "left_semi")
    # copies merge before the shuffle, so that a text that a third of the rows share is no large join key
    return rows.groupBy("h", "sha", "text").agg(F.max("doc_id").alias("doc_id"), F.sum("rows").alias("rows")).join(shared, "h", "left_semi")


def build_index(rows: DataFrame, entries: DataFrame, capacity: int = BUCKET_CAPACITY, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, Column]:
    """The index on shared files, and the expression that gives the bucket of a hash h.

    entries: (h, sha, keep_id, rows), one for each hash and digest; rows: (h, sha, text, doc_id, rows). The
    directory is split by the entries' hashes. Each owner task holds a range of buckets. A hash with one row is
    an entry as it is. Of a hash with several rows the texts are sent to its owner, where equal bytes become one
    entry, numbered along the hash's collision chain. Index: (bucket, h, chain, sha, keep_id, group_size).
    """
    depth, slots = directory(entries, capacity, max_depth)
    owner = bucket_of(depth, slots)
    compared = (
        _candidate_texts(rows, entries)
        .groupBy("h", "text")
        .agg(F.first("sha").alias("sha"), F.max("doc_id").alias("keep_id"), F.sum("rows").alias("group_size"))
        .select("h", "sha", "keep_id", "group_size", F.lit(True).alias("several"))
    )
    alone = entries.select("h", "sha", "keep_id", F.col("rows").alias("group_size"), F.lit(False).alias("several"))
    # an entry of one row that shares its hash with another text comes from both sides
    both = alone.where("group_size = 1").union(compared)
    bucketed = both.withColumn("bucket", owner)
    owners = min(slots[-1] + 1, int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if owners > 1:
        bucketed = bucketed.repartitionByRange(owners, "bucket")
    by_hash = Window.partitionBy("bucket", "h")
    shared = F.max("several").over(by_hash)
    chained = bucketed.withColumn("shared", shared).where("several or not shared")
    chain = F.row_number().over(by_hash.orderBy("sha", "keep_id"))
    index = stored(chained.withColumn("chain", chain).drop("several", "shared"), "hash-index")
    return index, owner


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = BUCKET_CAPACITY,
    max_depth: int = MAX_DEPTH,
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain.

    Texts are equal if their bytes are; a null text counts as empty. Of equal texts the largest id stays.
    Hash, digest and id of each row are written once; from them come the index's entries and directory. Texts
    move only where a hash has several rows, and merge in each map task first: a text that a third of all rows
    share leaves a task as one row. The owner of its bucket compares the bytes. Each row then finds its entry by
    bucket, hash and digest, over narrow rows.

    Null ids take part, but stay only where all ids of the group are null. A row that repeats the id
    and text that stay is marked kept too. Other columns are ignored, whatever their names. An empty
    table gives an empty table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.unhex(F.sha2(text, 256)).alias("sha"), text.alias("text"), F.lit(1).cast("long").alias("rows")
    )
    keys = stored(rows.select("doc_id", "h", "sha"), "hash-keys")
    entries = stored(keys.groupBy("h", "sha").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("rows")), "hash-entries")
    index, owner = build_index(rows, entries, capacity, max_depth)
    return keys.withColumn("bucket", owner).join(index, ["bucket", "h", "sha"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "bucket",
        "chain",
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row for each distinct text, all columns unchanged; see exact_dedup for which.

    Of rows that share the id and text that stay, the first by all other columns stays.
    """
    kept = exact_dedup(docs, id_col, text_col, **options).where("kept")
    key = lambda sha, ident: F.concat_ws(":", sha, ident.cast("string"))
    keep = kept.select(key(F.col("text_sha256"), F.col("doc_id")).alias("__kept")).distinct()
    own = key(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256), F.col(id_col).cast("long"))
    # the window has the join's key, so that texts are shuffled once for both
    joined = docs.withColumn("__own", own).join(keep, F.col("__own") == F.col("__kept"))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    order = [F.col(text_col).isNull(), *([F.to_json(F.struct(*others))] if others else [])]
    first = F.row_number().over(Window.partitionBy("__own").orderBy(*order))
    return joined.withColumn("__row", first).where("__row = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
