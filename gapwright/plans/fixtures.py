"""Tables with reproducible gaps: cells go by key arithmetic that any engine repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwright.operators.inject import by_key

KEYS = ["l_orderkey", "l_linenumber"]
MEASURES = ["l_quantity", "l_extendedprice", "l_discount"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with gaps in quantity, price and discount."""
    df = table(spark, sf_dir, "lineitem").select(*KEYS, "l_partkey", "l_suppkey", *MEASURES, "l_tax")
    df = by_key(df, "l_quantity", F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17, 10)
    df = by_key(df, "l_extendedprice", F.col("l_partkey") * 13 + F.col("l_linenumber") * 7, 8)
    return by_key(df, "l_discount", F.col("l_suppkey") * 11 + F.col("l_orderkey"), 9)


LINEITEM_GAPS = """
  select l_orderkey, l_linenumber, l_partkey, l_suppkey,
         case when (l_orderkey * 31 + l_linenumber * 17) % 10 <> 0 then l_quantity end as l_quantity,
         case when (l_partkey * 13 + l_linenumber * 7) % 8 <> 0 then l_extendedprice end as l_extendedprice,
         case when (l_suppkey * 11 + l_orderkey) % 9 <> 0 then l_discount end as l_discount, l_tax
  from lineitem
"""


def orders_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with gaps in status and priority."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    df = by_key(df, "o_orderstatus", F.col("o_orderkey") * 7 + F.col("o_custkey"), 11)
    return by_key(df, "o_orderpriority", F.col("o_orderkey") * 5 + F.col("o_custkey") * 3, 13)


ORDERS_GAPS = """
  select o_orderkey, o_custkey, case when (o_orderkey * 7 + o_custkey) % 11 <> 0 then o_orderstatus end as o_orderstatus,
         case when (o_orderkey * 5 + o_custkey * 3) % 13 <> 0 then o_orderpriority end as o_orderpriority, o_totalprice
  from orders
"""


def part_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part with gaps in the integer size."""
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return by_key(df, "p_size", F.col("p_partkey") * 3, 7)


PART_GAPS = "select p_partkey, case when (p_partkey * 3) % 7 <> 0 then p_size end as p_size, p_retailprice from part"


def hourly(spark: SparkSession, sf_dir: str, event_type: str = "click") -> DataFrame:
    """Hourly means of one kind of event; every 17th hour is left out."""
    events = table(spark, sf_dir, "events").where(F.col("event_type") == event_type)
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    out = events.groupBy(hour.alias("hour")).agg(F.round(F.avg("value"), 6).alias("value"))
    return out.where(F.unix_seconds(F.col("hour").cast("timestamp")) / 3600 % 17 != 0)


HOURLY = """
  select date_trunc('hour', ts)::timestamp as hour, round(avg(value), 6) as value from events where event_type = 'click'
  group by 1 having (epoch(date_trunc('hour', ts)::timestamp) / 3600)::bigint % 17 <> 0
"""
#: The same on its complete grid, numbered.
GRID = f"""
  select row_number() over (order by g.hour) - 1 as ord, g.hour, h.value
  from (select unnest(generate_series((select min(hour) from ({HOURLY})), (select max(hour) from ({HOURLY})), interval 1 hour)) as hour) g
  left join ({HOURLY}) h on g.hour = h.hour
"""
