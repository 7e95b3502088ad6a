"""Regular time grids: the step of a series, and the series on every step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gapwright.errors import GapTypeError, GapValueError

#: Grid points that one task orders; a longer series is cut into buckets with a halo.
BUCKET = 100_000
TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def check_time(df: DataFrame, time_col: str) -> None:
    if not isinstance(time_col, str):
        raise GapTypeError("the time column must be given by name")
    if time_col not in df.columns:
        raise GapValueError(f"unknown time column {time_col}")
    if not isinstance(df.schema[time_col].dataType, TIMES):
        raise GapTypeError(f"column {time_col} must hold dates or timestamps")


def micros(c: Column) -> Column:
    """Microseconds since the epoch (of wall-clock times as if in UTC)."""
    return F.unix_micros(c.cast("timestamp"))


def step_facts(df: DataFrame, time_col: str) -> DataFrame:
    """One row: points, distinct, nulls, first, last, base (least positive gap) and
    odd (gaps that the base does not divide), times in microseconds."""
    t = df.select(micros(F.col(f"`{time_col}`")).alias("t"))
    total = t.agg(F.count("*").alias("rows"), F.count("t").alias("points"), F.countDistinct("t").alias("distinct"), F.min("t").alias("first"), F.max("t").alias("last"))
    # gaps between neighbours: buckets by range keep the ordering off a single task
    spread = t.where("t is not null").repartitionByRange("t").sortWithinPartitions("t").withColumn("p", F.spark_partition_id())
    inner = spread.withColumn("d", F.col("t") - F.lag("t").over(Window.partitionBy("p").orderBy("t")))
    edges = spread.groupBy("p").agg(F.min("t").alias("low"), F.max("t").alias("high"))  # one row a partition
    seams = edges.select((F.col("low") - F.lag("high").over(Window.orderBy("p"))).alias("d"))
    gaps = inner.select("d").unionByName(seams).where("d > 0")
    base = gaps.agg(F.min("d").alias("base"))
    odd = gaps.crossJoin(F.broadcast(base)).agg(F.max("base").alias("base"), F.count_if(F.pmod("d", "base") != 0).alias("odd"))  # base is one row
    return total.crossJoin(odd)  # one row by one row


def infer_step(df: DataFrame, time_col: str) -> int:
    """The step in microseconds: the least positive gap, which must divide every other."""
    check_time(df, time_col)
    f = step_facts(df, time_col).first()
    if f["points"] != f["rows"]:
        raise GapValueError("the time column has missing values")
    if f["points"] < 2:
        raise GapValueError("a series needs two points at least, or an explicit step")
    if f["distinct"] != f["points"]:
        raise GapValueError("the time column has repeated values")
    if f["odd"]:
        raise GapValueError("the time steps are irregular: no step divides all gaps")
    return f["base"]


def calendar_order(df: DataFrame, time_col: str) -> Column | None:
    """Ordinals of a series on every month (or k-th month) or on every weekday, else None.

    Such a series of three points at least has no fixed step but is complete
    as it is: months have one day of the month, or all are month ends, and one
    time of day; weekdays cross a weekend.  One aggregate tells.
    """
    t = F.col(f"`{time_col}`")
    day = F.datediff(t.cast("date"), F.lit("1970-01-05").cast("date"))  # a Monday
    month = F.year(t) * 12 + F.month(t)
    work = F.floor(day / 7) * 5 + F.weekday(t)
    clock = F.pmod(micros(t), F.lit(86_400_000_000))
    f = df.agg(
        F.count("*").alias("rows"), F.countDistinct(t).alias("points"), F.min(clock).alias("c0"), F.max(clock).alias("c1"),
        F.min(month).alias("m0"), F.max(month).alias("m1"), F.countDistinct(month).alias("months"), F.min(F.day(t)).alias("d0"), F.max(F.day(t)).alias("d1"),
        F.min(F.last_day(t) == t.cast("date")).alias("ends"), F.max(F.weekday(t)).alias("late"), F.min(work).alias("w0"), F.max(work).alias("w1"),
        F.min(day).alias("day0"), F.max(day).alias("day1"),
    ).first()
    n = f["rows"]
    if n < 3 or f["points"] != n or f["c0"] != f["c1"]:
        return None
    if f["months"] == n and (f["d0"] == f["d1"] or f["ends"]) and (f["m1"] - f["m0"]) % (n - 1) == 0:
        k = (f["m1"] - f["m0"]) // (n - 1)
        if df.where(F.pmod(month - f["m0"], F.lit(k)) != 0).isEmpty():
            return ((month - f["m0"]) / k).cast("bigint")
    if f["late"] <= 4 and f["w1"] - f["w0"] + 1 == n and f["day1"] - f["day0"] + 1 > n:
        return (work - f["w0"]).cast("bigint")
    return None


def regularise(df: DataFrame, time_col: str, step: int | str | None = None) -> DataFrame:
    """``df`` on the complete grid from its first to its last time, with ``__ord`` from 0.

    ``step`` is in microseconds, or a calendar interval such as "1 month" (the
    grid starts at the first time), or None to infer it; a complete series of
    months or weekdays is its own grid.  Rows off the grid of
    an explicit step are dropped, as a reindexed frame drops them.
    """
    check_time(df, time_col)
    kind = df.schema[time_col].dataType
    if step is None:
        order = calendar_order(df, time_col)
        if order is not None:
            return df.withColumn("__ord", order)
        step = infer_step(df, time_col)
    first, last = df.agg(F.min(f"`{time_col}`"), F.max(f"`{time_col}`")).first()
    if first is None:
        return df.withColumn("__ord", F.lit(None).cast("bigint"))
    if isinstance(step, str):
        grid = _calendar_grid(df, time_col, step)
    else:
        ends = df.agg(F.min(micros(F.col(f"`{time_col}`"))).alias("a"), F.max(micros(F.col(f"`{time_col}`"))).alias("b")).first()
        points = (ends["b"] - ends["a"]) // step + 1
        at = F.timestamp_micros(F.lit(ends["a"]) + F.col("id") * step)
        grid = df.sparkSession.range(points).select(F.col("id").alias("__ord"), at.cast(kind).alias(time_col))
    return grid.join(df, time_col, "left").select(*(F.col(f"`{c}`") for c in df.columns), "__ord")


def _calendar_grid(df: DataFrame, time_col: str, step: str) -> DataFrame:
    """(__ord, time): the first time plus whole multiples of a calendar step, dealt over tasks by number.

    The first step's length bounds how many there can be (no month is shorter
    than nine tenths of another); those beyond the last time are left out.
    """
    kind = df.schema[time_col].dataType
    row = df.agg(F.min(f"`{time_col}`").alias("a"), F.max(f"`{time_col}`").alias("b"))
    found = row.select((micros(F.col("b")) - micros(F.col("a"))).alias("span"), (micros(F.expr(f"a + interval {step}")) - micros(F.col("a"))).alias("one")).first()
    if found["one"] <= 0:
        raise GapValueError(f"the step {step} does not lead onwards")
    most = int(found["span"] / (0.9 * found["one"])) + 2
    point = F.expr(f"cast(a + cast(__ord as int) * interval {step} as {kind.simpleString()})")
    grid = df.sparkSession.range(most).select(F.col("id").alias("__ord")).crossJoin(F.broadcast(row))  # with one row
    return grid.withColumn(time_col, point).where(F.col(f"`{time_col}`") <= F.col("b")).select("__ord", f"`{time_col}`")


def with_neighbours(df: DataFrame, columns: dict[str, Column], halo: int, order: str = "__ord", bucket: int = BUCKET) -> DataFrame:
    """Adds window columns that look at most ``halo`` rows to either side.

    ``columns`` are expressions over ``Window.partitionBy("__bucket").orderBy(order)``
    by name.  ``order`` numbers the rows from 0 without holes.  Every bucket also
    gets the ``halo`` rows around it, so a long series is ordered by many tasks
    and each value is what one global window would give.
    """
    bucket = max(bucket, halo + 1)
    home = F.floor(F.col(order) / bucket)
    places = F.array_distinct(F.array(F.floor((F.col(order) - halo) / bucket), home, F.floor((F.col(order) + halo) / bucket)))
    dealt = df.withColumn("__home", home).withColumn("__bucket", F.explode(places))
    return dealt.withColumns(columns).where("__home = __bucket").drop("__home", "__bucket")


def along(order: str = "__ord") -> Window:
    return Window.partitionBy("__bucket").orderBy(order)
