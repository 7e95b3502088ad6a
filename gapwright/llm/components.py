"""Connected components of an edge table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwright.llm.common import discard, written


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: bigint); root is the
    smallest node of its component.

    Alternating star contraction: each node's larger neighbours are hung on
    its smallest one, then its smaller ones, until the edges are stars.  A
    node of any degree is met by a partial minimum and a join, never by a list.
    Minima are dealt anew before they are joined on their own key: both sides
    of the join are then plain exchanges, and Spark can split a hub that a
    third of all edges share.  Every round ends in a written table.
    An empty table gives an empty result; loops, repeated edges and nulls are
    ignored.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = written(now, "edges")
    seal = _seal(now)
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).repartition(tasks)
        hung = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = hung.groupBy("u").agg(F.min("v").alias("m")).repartition(tasks)
        near = hung.join(low, "u")
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        past, now = now, written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(past)
        after = _seal(now)
        if after == seal:
            break
        seal = after
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _seal(edges: DataFrame) -> tuple:
    """Tells edge sets apart: size and an order-free checksum."""
    folded = F.expr("bit_xor(xxhash64(u, v))")
    low = F.sum(F.expr("xxhash64(u, v, 7) & 4294967295"))
    return tuple(edges.agg(F.count("*"), folded, low).first())
