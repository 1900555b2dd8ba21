"""Connected components of a graph given as a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardflow.llm.common import fresh_path, remove


def _signature(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): each node of edges (u, v: long), with the smallest node that it is linked to. Isolated nodes have no row.

    A round links each node's larger neighbours, then its smaller ones, to the smallest of them; it ends when nothing changes. Each
    round is written to the shared folder, the one before is deleted, and the driver sees only a count and a hash. Rounds grow with the logarithm of the nodes; a table that
    still changes after so many is an error. The sums of a hub's edges are partial ones, but they meet in one task of a join, as numbers. An edge table with null ends loses those rows."""
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    spark, kind = e.sparkSession, "u long, v long"

    def put(df: DataFrame) -> tuple[DataFrame, str]:
        df.select(F.col("u").cast("long"), F.col("v").cast("long")).write.parquet(path := fresh_path(spark, "edges"))
        return spark.read.schema(kind).parquet(path), path

    e, at = put(e)
    now = _signature(e)
    for _ in range(rounds):
        if not now[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).where("m < u")
        # Nodes that are the least of their neighbours have no row in low and keep their edges.
        up = e.select(F.col("v").alias("u"), F.col("u").alias("v")).join(low, "u", "left")
        large = up.select(F.col("v").alias("u"), F.coalesce("m", "u").alias("v"))
        large = large.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        old = at
        e, at = put(small)
        remove(spark, old)
        before, now = now, _signature(e)
        if now == before:
            break
    else:
        raise RuntimeError(f"components are not complete after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
