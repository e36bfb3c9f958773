"""The market tables that the engine works on, as views over the warehouse tables.

Ticks are order lines: the asset is the part's brand, the price the extended price over the quantity, the volume the
quantity. Daily and weekly bars are merged from them; hourly bars come from the events stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.bars import merge_bars


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str, asset: str = "p_brand") -> DataFrame:
    """asset, at, price, volume, and ord, a total order of a day's ticks."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", asset)
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col(asset).alias("asset"),
        F.col("l_shipdate").alias("at"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("volume"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("ord"),
    )


def packed(*parts: tuple[Column, int]) -> Column:
    """Whole numbers that aren't negative, in a fixed number of digits each, as one number with the same order. An aggregate that compares it keeps it in
    place in its hash table, where a struct would make Spark sort."""
    place, total = 1, F.lit(0).cast("decimal(38,0)")
    for column, digits in reversed(parts):
        total = total + (column.cast("decimal(19,0)") * F.expr(f"CAST({place} AS DECIMAL(38,0))")).cast("decimal(38,0)")
        place *= 10**digits
    return total.cast("decimal(38,0)")


def tick_order() -> Column:
    """The total order of ticks as one number."""
    return packed(*[(F.col(f"ord.{c}"), digits) for c, digits in (("l_orderkey", 14), ("l_linenumber", 2), ("l_partkey", 11), ("l_suppkey", 10))])


def bars(spark: SparkSession, sf_dir: str, unit: str = "day", asset: str = "p_brand") -> DataFrame:
    """asset, ts, open, high, low, close, volume."""
    own = ticks(spark, sf_dir, asset).select("asset", F.date_trunc(unit, "at").alias("ts"), *[F.col("price").alias(c) for c in ("open", "high", "low", "close")], "volume", tick_order().alias("ord"))
    return merge_bars(own)


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the events: asset is the event type, the price its value, the volume a count."""
    own = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("asset"), F.date_trunc("hour", "ts").alias("ts"), *[F.col("value").alias(c) for c in ("open", "high", "low", "close")],
        F.lit(1.0).alias("volume"), packed((F.unix_micros(F.col("ts").cast("timestamp")), 17), (F.col("event_id"), 19)).alias("ord"),
    )
    return merge_bars(own)


def number_of(asset: Column) -> Column:
    return F.regexp_extract(asset, r"(\d+)", 1).cast("int")


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The asset dimension: class (0 stock, 1 ETF, 2 crypto, 3 index), region, capitalisation and rank of each brand."""
    own = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("asset")).agg(F.sum("p_retailprice").alias("market_cap"), F.count(F.lit(1)).alias("listings"))
    n = number_of(F.col("asset"))
    return own.select(
        "asset",
        (n % 4).alias("cls"),
        F.element_at(F.array(F.lit("AMER"), F.lit("ASIA"), F.lit("EURO")), n % 3 + 1).alias("region"),
        F.when(n % 5 != 0, F.concat(F.lit("S"), (n % 5).cast("string"))).alias("sector"),
        F.when(n % 7 != 0, n).alias("cap_rank"),
        "market_cap",
        "listings",
    )


#: The same views for DuckDB; every oracle starts with those that it needs.
TICK_SQL = """tick AS (
  SELECT p_brand AS asset, p_type AS kind, l_shipdate AS shipped, l_extendedprice / l_quantity AS price, l_quantity AS volume,
         l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
ORDER_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def bars_sql(unit: str = "day", name: str = "bars", asset: str = "asset") -> str:
    return f"""{name} AS (
  SELECT {asset} AS asset, CAST(date_trunc('{unit}', shipped) AS TIMESTAMP) AS ts, first(price ORDER BY {ORDER_SQL}) AS open,
         max(price) AS high, min(price) AS low, last(price ORDER BY {ORDER_SQL}) AS close, sum(volume) AS volume
  FROM tick GROUP BY 1, 2)"""


DAILY_SQL = f"{TICK_SQL}, {bars_sql()}"
WEEKLY_SQL = f"{TICK_SQL}, {bars_sql('week')}"
HOURLY_SQL = """bars AS (
  SELECT event_type AS asset, CAST(date_trunc('hour', events.ts) AS TIMESTAMP) AS ts, first(value ORDER BY events.ts, event_id) AS open, max(value) AS high,
         min(value) AS low, last(value ORDER BY events.ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY 1, 2)"""
ASSET_SQL = """assets AS (
  SELECT asset, n % 4 AS cls, CASE n % 3 WHEN 0 THEN 'AMER' WHEN 1 THEN 'ASIA' ELSE 'EURO' END AS region,
         CASE WHEN n % 5 <> 0 THEN 'S' || (n % 5) END AS sector, CASE WHEN n % 7 <> 0 THEN n END AS cap_rank, market_cap, listings
  FROM (SELECT p_brand AS asset, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT) AS n, sum(p_retailprice) AS market_cap, count(*) AS listings
        FROM part GROUP BY 1))"""
