"""Runs of missing cells in a regular series, and interpolation of short ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gapwright.errors import GapTypeError, GapValueError
from gapwright.functions.cells import missing, number, restore
from gapwright.operators.timegrid import along, with_neighbours


def gap_runs(df: DataFrame, column: str, order: str = "__ord") -> DataFrame:
    """(start, end, length, prev, next) of every run of missing cells.

    Gaps and islands without a global running sum: observed rows are few or
    many, but each only asks for the observed row before it.  prev and next
    are the observed values around a run.
    """
    kind = df.schema[column].dataType
    last = df.agg(F.max(order).alias("top")).first()["top"]
    seen = df.where(~missing(column, kind)).select(F.col(order).alias("o"), F.col(column).alias("v"))
    # neighbours among observed rows, by ranges of the order
    spread = seen.repartitionByRange("o").sortWithinPartitions("o").withColumn("p", F.spark_partition_id())
    w = Window.partitionBy("p").orderBy("o")
    inner = spread.select("o", "v", F.lag("o").over(w).alias("po"), F.lag("v").over(w).alias("pv"), "p")
    tails = spread.groupBy("p").agg(F.max("o").alias("o"), F.max_by("v", "o").alias("v"), F.min("o").alias("lo"), F.min_by("v", "o").alias("lv"))
    over = Window.orderBy("lo")  # one row a partition
    seams = tails.select(F.col("lo").alias("o"), F.col("lv").alias("v"), F.lag("o").over(over).alias("po"), F.lag("v").over(over).alias("pv"))
    pairs = inner.where("po is not null").select("o", "v", "po", "pv").unionByName(seams)
    between = pairs.where(F.col("o") - F.coalesce("po", F.lit(-1)) > 1)
    runs = between.select((F.coalesce("po", F.lit(-1)) + 1).alias("start"), (F.col("o") - 1).alias("end"), F.col("pv").alias("prev"), F.col("v").alias("next"))
    final = seen.agg(F.max("o").alias("o"), F.max_by("v", "o").alias("v"))
    open_end = final.where(F.coalesce("o", F.lit(-1)) < F.lit(last)).select((F.coalesce("o", F.lit(-1)) + 1).alias("start"), F.lit(last).alias("end"), F.col("v").alias("prev"), F.lit(None).cast(kind).alias("next"))
    return runs.unionByName(open_end).select("start", "end", (F.col("end") - F.col("start") + 1).alias("length"), "prev", "next")


def check_gap(n: object) -> int:
    if isinstance(n, bool) or not isinstance(n, int):
        raise GapTypeError("the longest gap to interpolate must be an integer")
    if n < 0:
        raise GapValueError("the longest gap to interpolate must not be negative")
    return n


def interpolate(df: DataFrame, columns: list[str], longest: int, order: str = "__ord") -> DataFrame:
    """Fills runs of at most ``longest`` missing cells.

    Between two observed values the fill is linear in the row number; at the
    end of the series the last value is carried on; leading runs stay.  Only
    ``longest`` + 1 rows to either side are looked at, so the series can be cut
    anywhere.
    """
    longest = check_gap(longest)
    if not longest or not columns:
        return df
    final = df.agg(F.max(order)).first()[0]
    back, ahead = along(order).rowsBetween(-longest - 1, -1), along(order).rowsBetween(1, longest + 1)
    helper: dict[str, Column] = {}
    for i, c in enumerate(columns):
        x = number(c, df.schema[c].dataType)
        at = F.when(x.isNotNull(), F.col(order))
        helper |= {
            f"__pv{i}": F.last(x, ignorenulls=True).over(back), f"__po{i}": F.last(at, ignorenulls=True).over(back),
            f"__nv{i}": F.first(x, ignorenulls=True).over(ahead), f"__no{i}": F.first(at, ignorenulls=True).over(ahead),
        }
    wide = with_neighbours(df, helper, longest + 1, order)
    out = {}
    for i, c in enumerate(columns):
        kind = df.schema[c].dataType
        pv, po, nv, no = (F.col(f"__{k}{i}") for k in ("pv", "po", "nv", "no"))
        linear = pv + (nv - pv) * F.try_divide((F.col(order) - po).cast("double"), (no - po).cast("double"))
        short = (no - po - 1) <= longest
        trailing = no.isNull() & (F.lit(final) - po <= longest)
        value = F.when(short, linear).when(trailing, pv)
        out[c] = F.when(missing(c, kind), F.coalesce(restore(value, kind), F.col(f"`{c}`"))).otherwise(F.col(f"`{c}`"))
    return wide.withColumns(out).select(*(F.col(f"`{c}`") for c in df.columns))
