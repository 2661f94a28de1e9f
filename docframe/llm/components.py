"""Connected components over a table of edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.storage import new_path, remove


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the smallest node it sees."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node (u > v always holds here) ties itself and its smaller neighbours to the smallest."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for every node that has an edge; component is the smallest node reachable.

    Edges may repeat and may point either way; loops and rows with a null end are ignored. Each round is
    two aggregations and two joins on the node, partial before each shuffle; a hub with many neighbours
    is a large join key, which adaptive execution splits. After each round the edges are written to the
    shared folder, and those of the round before are removed. Rounds end when the edges no longer change,
    which they do: a round only ever moves edges to smaller nodes, so that the sum of their ends falls
    until every component is a star. An empty table gives an empty table.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    spark = edges.sparkSession
    first = edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()

    def write(df: DataFrame) -> tuple[str, DataFrame, tuple]:
        path = new_path(spark, "edges")
        df.write.parquet(path)
        table = spark.read.schema(first.schema).parquet(path)
        return path, table, _signature(table)

    path, now, before = write(first)
    while before[0]:
        last = path
        path, now, after = write(_small_star(_large_star(now)))
        remove(spark, last)
        if after == before:
            break
        before = after
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(nodes.select(F.col("component").alias("node"), "component").distinct())
