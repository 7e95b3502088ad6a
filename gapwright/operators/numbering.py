"""Row numbers over a whole table without a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that the bounds of ranges are drawn from, and about as many rows a range.
SAMPLE, RANGE = 10_000, 100_000
#: Most ranges.
RANGES = 2_000


def numbered(df: DataFrame, order: list[str], name: str, salt: list[str] | None = None) -> tuple[DataFrame, int]:
    """``df`` with a number from 0 in the order of some columns, and how many rows there are.

    Bounds between ranges are taken from a bounded sample once and are literals
    of the plan, so every evaluation gives the same numbers (rows that are equal
    in ``order`` share them out among each other).  Each range is then numbered
    by a task of its own, on from the counts of those before it.
    """
    key = F.struct(*(F.col(f"`{c}`") for c in order))
    total = df.count()
    ranges = min(RANGES, total // RANGE + 1)
    bounds = []
    if ranges > 1:
        share = min(1.0, 4.0 * SAMPLE / total)
        found = df.where(F.rand(7) < share).select(key.alias("k")).limit(8 * SAMPLE).select("k").orderBy("k").collect()
        bounds = [found[i * len(found) // ranges]["k"] for i in range(1, ranges)] if found else []
    spark = df.sparkSession
    schema = df.select(key.alias("k")).schema
    low = spark.createDataFrame([(b,) for b in bounds], schema).distinct().agg(F.sort_array(F.collect_list("k")).alias("b"))  # one row, at most RANGES bounds
    part, bound = f"{name}_range", f"{name}_bounds"
    dealt = df.crossJoin(F.broadcast(low.withColumnRenamed("b", bound)))  # with one row
    dealt = dealt.withColumn(part, F.size(F.filter(bound, lambda b: b <= key))).drop(bound)
    sizes = {r[part]: r["count"] for r in dealt.groupBy(part).count().collect()}  # at most RANGES rows
    starts, at = [], 0
    for p in range(max(sizes, default=-1) + 1):
        starts.append(at)
        at += sizes.get(p, 0)
    first = F.element_at(F.array(*(F.lit(x).cast("bigint") for x in starts or [0])), F.col(part) + 1)
    number = first + F.row_number().over(Window.partitionBy(part).orderBy(*(F.col(f"`{c}`") for c in order))) - 1
    return dealt.withColumn(name, number).drop(part), total
