"""Sources, upserts, cleaning and quality (A and B of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import bars as ops
from tidewater.sources import tables as t

from .registry import query, rounded

D, A = t.DAILY_SQL, t.ASSET_SQL

EARLY, LATE = "l_linenumber <= 4", "l_linenumber > 4"


def batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The bars of the first four lines of orders, and a later batch of the others."""
    own = t.ticks(spark, sf_dir).select("asset", F.date_trunc("day", "at").alias("ts"), *[F.col("price").alias(c) for c in ("open", "high", "low", "close")], "volume", t.tick_order().alias("ord"), F.col("ord.l_linenumber").alias("line"))
    return ops.merge_bars(own.where("line <= 4")), ops.merge_bars(own.where("line > 4"))


BATCH_SQL = f"{t.TICK_SQL}, {t.bars_sql('day', 'old').replace('FROM tick', f'FROM tick WHERE {EARLY}')}, {t.bars_sql('day', 'new').replace('FROM tick', f'FROM tick WHERE {LATE}')}"


@query("a1_bar_scan", f"WITH {D} SELECT asset, ts, close, volume FROM bars WHERE asset = 'Brand#12' AND ts >= '1997-01-01' AND ts < '2000-01-01'")
def bar_scan(spark, sf_dir):
    return t.bars(spark, sf_dir).where("asset = 'Brand#12' AND ts >= '1997-01-01' AND ts < '2000-01-01'").select("asset", "ts", "close", "volume")


@query("a2_multi_asset_scan", f"WITH {D}, {A} SELECT asset, ts, open, high, low, close, volume FROM bars WHERE asset IN (SELECT asset FROM assets WHERE cls = 2)")
def multi_asset_scan(spark, sf_dir):
    wanted = t.assets(spark, sf_dir).where("cls = 2").select("asset")
    return t.bars(spark, sf_dir).join(wanted, "asset", "left_semi")


#: When the table and the batch were taken in.
STAMPS = ("TIMESTAMP '2002-01-01 00:00:00'", "TIMESTAMP '2002-01-02 00:00:00'")


@query("a3_bar_upsert", f"""WITH {BATCH_SQL}
    SELECT coalesce(n.asset, o.asset) AS asset, coalesce(n.ts, o.ts) AS ts,
           CASE WHEN n.asset IS NOT NULL THEN n.open ELSE o.open END AS open, CASE WHEN n.asset IS NOT NULL THEN n.high ELSE o.high END AS high,
           CASE WHEN n.asset IS NOT NULL THEN n.low ELSE o.low END AS low, CASE WHEN n.asset IS NOT NULL THEN n.close ELSE o.close END AS close,
           CASE WHEN n.asset IS NOT NULL THEN n.volume ELSE o.volume END AS volume, CASE WHEN n.asset IS NOT NULL THEN {STAMPS[1]} ELSE {STAMPS[0]} END AS ingested
    FROM old o FULL JOIN new n ON o.asset = n.asset AND o.ts = n.ts""")
def bar_upsert(spark, sf_dir):
    old, new = batches(spark, sf_dir)
    return ops.upsert(ops.stamped(old, F.expr(STAMPS[0])), ops.stamped(new, F.expr(STAMPS[1])), ["asset", "ts"])


@query("a4_batch_dedup", f"""WITH {t.TICK_SQL}
    SELECT asset, CAST(date_trunc('day', shipped) AS TIMESTAMP) AS ts, last(price ORDER BY {t.ORDER_SQL}) AS price, last(volume ORDER BY {t.ORDER_SQL}) AS volume
    FROM tick GROUP BY 1, 2""")
def batch_dedup(spark, sf_dir):
    own = t.ticks(spark, sf_dir).withColumn("ts", F.date_trunc("day", "at"))
    return ops.last_of_batch(own, ["asset", "ts"], [F.desc("ord"), F.desc("price"), F.desc("volume")]).select("asset", "ts", "price", "volume")


@query("a5_asset_upsert", """WITH o AS (SELECT p_brand AS asset, CASE WHEN count(*) % 2 = 0 THEN max(p_type) END AS kind, min(p_name) AS provider FROM part WHERE p_size <= 25 GROUP BY 1),
    n AS (SELECT p_brand AS asset, CASE WHEN count(*) % 3 = 0 THEN min(p_type) END AS kind, CASE WHEN count(*) % 5 <> 0 THEN max(p_name) END AS provider FROM part WHERE p_size > 25 GROUP BY 1)
    SELECT coalesce(n.asset, o.asset) AS asset, coalesce(n.kind, o.kind) AS kind, CASE WHEN n.asset IS NOT NULL THEN n.provider ELSE o.provider END AS provider
    FROM o FULL JOIN n ON o.asset = n.asset""")
def asset_upsert(spark, sf_dir):
    parts, n = t.table(spark, sf_dir, "part"), F.count(F.lit(1))
    old = parts.where("p_size <= 25").groupBy(F.col("p_brand").alias("asset")).agg(F.when(n % 2 == 0, F.max("p_type")).alias("kind"), F.min("p_name").alias("provider"))
    new = parts.where("p_size > 25").groupBy(F.col("p_brand").alias("asset")).agg(F.when(n % 3 == 0, F.min("p_type")).alias("kind"), F.when(n % 5 != 0, F.max("p_name")).alias("provider"))
    return ops.upsert_keeping(old, new, ["asset"], ("provider",))


@query("a7_insert_absent", f"WITH {BATCH_SQL} SELECT n.asset, n.ts, n.close FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.asset = n.asset AND o.ts = n.ts)")
def insert_absent(spark, sf_dir):
    old, new = batches(spark, sf_dir)
    return ops.insert_absent(old, new, ["asset", "ts"]).select("asset", "ts", "close")


@query("a12_incremental_range", f"""WITH {BATCH_SQL}, m AS (SELECT max(ts) AS to_ts FROM new), l AS (SELECT asset, max(ts) AS last_ts FROM old GROUP BY 1)
    SELECT w.asset, coalesce(last_ts - INTERVAL 5 DAY, to_ts - INTERVAL 24 MONTH) AS from_ts, to_ts
    FROM (SELECT DISTINCT asset FROM new) w LEFT JOIN l ON l.asset = w.asset CROSS JOIN m""")
def incremental_range(spark, sf_dir):
    old, new = batches(spark, sf_dir)
    return ops.incremental_range(old, new, "5 DAYS", "24 MONTHS")


@query("a13_top_of_class", f"""WITH {A} SELECT asset, cls, cap_rank, place, place <= 3 AS is_tracked FROM (
    SELECT *, row_number() OVER (PARTITION BY cls ORDER BY cap_rank ASC NULLS LAST, market_cap DESC, asset) AS place FROM assets)""")
def top_of_class(spark, sf_dir):
    return ops.top_of_class(t.assets(spark, sf_dir), 3).select("asset", "cls", "cap_rank", "place", "is_tracked")


@query("a14_asset_search", f"WITH {A} SELECT asset, cls, region FROM assets WHERE cls = 1 AND lower(asset) LIKE '%#1%' ORDER BY asset LIMIT 20")
def asset_search(spark, sf_dir):
    return t.assets(spark, sf_dir).where((F.col("cls") == 1) & F.lower("asset").contains("#1")).orderBy("asset").limit(20).select("asset", "cls", "region")


RETENTION = {
    "old_ticks": ("lineitem", "l_shipdate < TIMESTAMP '1996-01-01 00:00:00'"),
    "zero_discount": ("lineitem", "l_discount = 0"),
    "old_orders": ("orders", "o_orderdate < TIMESTAMP '1996-01-01 00:00:00'"),
    "errors": ("events", "event_type = 'error'"),
    "empty_texts": ("documents", "length(coalesce(text, '')) < 100"),
}


@query("a15_retention_dry_run", " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) AS n_rows, count(*) FILTER ({p}) AS n_removed FROM {tab}" for k, (tab, p) in RETENTION.items()))
def retention_dry_run(spark, sf_dir):
    parts = [t.table(spark, sf_dir, tab).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.expr(p)).alias("n_removed")).select(F.lit(k).alias("rule"), "n_rows", "n_removed") for k, (tab, p) in RETENTION.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("a15_superseded_runs", """SELECT o_orderkey, o_custkey FROM orders o
    WHERE o_orderdate < (SELECT max(o_orderdate) FROM orders i WHERE i.o_custkey = o.o_custkey)""")
def superseded_runs(spark, sf_dir):
    orders = t.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    newest = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("_newest"))
    return orders.join(newest, "o_custkey").where("o_orderdate < _newest").select("o_orderkey", "o_custkey")


@query("a16_key_backfill", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(CASE WHEN l_returnflag <> 'N' THEN l_shipdate END, o_orderdate) AS settled
    FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""")
def key_backfill(spark, sf_dir):
    lines = t.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_returnflag") != "N", F.col("l_shipdate")).alias("_at"))
    orders = t.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce("_at", "o_orderdate").alias("settled"))


@query("b1_snap", "SELECT event_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour FROM events")
def snap(spark, sf_dir):
    return t.table(spark, sf_dir, "events").select("event_id", ops.snap(F.col("ts"), "1d").alias("day"), ops.snap(F.col("ts"), "1h").alias("hour"))


@query("b2_bar_merge", f"WITH {D} SELECT asset, ts, open, high, low, close, volume FROM bars")
def bar_merge(spark, sf_dir):
    return t.bars(spark, sf_dir)


@query("b2_hourly_bars", f"WITH {t.HOURLY_SQL} SELECT asset, ts, open, high, low, close, volume FROM bars")
def hourly(spark, sf_dir):
    return t.hourly_bars(spark, sf_dir)


KEPT_SQL = """, r AS (SELECT asset, ts, close, lead(close) OVER (PARTITION BY asset ORDER BY ts) AS nxt, row_number() OVER (PARTITION BY asset ORDER BY ts) AS i FROM bars),
    f AS (
      SELECT asset, i, ts, close > 0 AS kept, CAST(NULL AS DOUBLE) AS factor, CASE WHEN close > 0 THEN close END AS anchor FROM r WHERE i = 1
      UNION ALL
      SELECT r.asset, r.i, r.ts, r.close > 0 AND (f.anchor IS NULL OR r.close / f.anchor BETWEEN 0.1 AND 10 OR coalesce(r.nxt > 0 AND r.nxt / r.close BETWEEN 0.1 AND 10, false)),
             greatest(r.close / f.anchor, f.anchor / r.close),
             CASE WHEN r.close > 0 AND (f.anchor IS NULL OR r.close / f.anchor BETWEEN 0.1 AND 10 OR coalesce(r.nxt > 0 AND r.nxt / r.close BETWEEN 0.1 AND 10, false)) THEN r.close ELSE f.anchor END
      FROM f JOIN r ON r.asset = f.asset AND r.i = f.i + 1)"""
FLAGS_SQL = f"WITH RECURSIVE {D}{KEPT_SQL}"


@query("b3_outlier_filter", f"{FLAGS_SQL} SELECT asset, ts, kept, round(factor, 6) AS factor FROM f")
def outlier_filter(spark, sf_dir):
    return rounded(ops.flag_outliers(t.bars(spark, sf_dir), ops.JUMP["1d"]).select("asset", "ts", "kept", "factor"))


@query("b4_quality_report", f"""{FLAGS_SQL} SELECT asset, count(*) FILTER (kept) AS n_kept, count(*) FILTER (NOT kept) AS n_rejected, round(max(factor), 6) AS worst,
    round(count(*) FILTER (NOT kept) / count(*), 6) AS reject_ratio, count(*) FILTER (NOT kept) / count(*) >= 0.02 AS suspicious FROM f GROUP BY 1""")
def quality_report(spark, sf_dir):
    return rounded(ops.quality_report(ops.flag_outliers(t.bars(spark, sf_dir), ops.JUMP["1d"])))


@query("a11_ingest", f"""{FLAGS_SQL} SELECT asset, count(*) AS fetched, count(*) FILTER (NOT kept) AS rejected, count(*) FILTER (kept) AS written, count(*) FILTER (kept OR ts < TIMESTAMP '1995-01-01') AS stored FROM f GROUP BY 1""")
def ingest(spark, sf_dir):
    bars = t.bars(spark, sf_dir)
    table, report = ops.ingest(bars, bars.where("ts < TIMESTAMP '1995-01-01'"), ops.JUMP["1d"])
    return report.join(table.groupBy("asset").agg(F.count(F.lit(1)).alias("stored")), "asset")


@query("b5_jumpy_assets", f"""WITH {D}, s AS (SELECT asset, close / lag(close) OVER (PARTITION BY asset ORDER BY ts) AS f FROM bars WHERE close > 0)
    SELECT asset, count(*) AS jumps, round(max(greatest(f, 1 / f)), 6) AS worst FROM s WHERE greatest(f, 1 / f) > 8 GROUP BY 1 HAVING count(*) >= 2""")
def jumpy_assets(spark, sf_dir):
    return rounded(ops.jumpy(t.bars(spark, sf_dir), 8.0, 2))


@query("b6_flat_assets", f"""WITH {D}, m AS (SELECT asset, avg(close) AS mean_close, stddev_samp(close) / avg(close) AS rel_sd FROM bars GROUP BY 1)
    SELECT asset, round(mean_close, 6) AS mean_close, round(rel_sd, 6) AS rel_sd,
           (mean_close BETWEEN 0.9 AND 1.1 AND coalesce(rel_sd < 0.02, false)) OR rel_sd IS NULL OR rel_sd < 1e-5 OR abs(mean_close) < 1e-9 AS is_flat FROM m""")
def flat_assets(spark, sf_dir):
    return rounded(ops.flat(t.bars(spark, sf_dir)))


@query("b7_reference_mismatch", f"""WITH {D}, l AS (SELECT asset, arg_max(close, ts) AS last_close FROM bars GROUP BY 1),
    r AS (SELECT p_brand AS asset, avg(p_retailprice) AS reference_price FROM part GROUP BY 1)
    SELECT asset, round(last_close, 6) AS last_close, round(reference_price, 6) AS reference_price, round(greatest(last_close / reference_price, reference_price / last_close), 6) AS factor,
           greatest(last_close / reference_price, reference_price / last_close) > 3 AS mismatch FROM l JOIN r USING (asset)""")
def reference_mismatch(spark, sf_dir):
    own = t.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("asset")).agg(F.avg("p_retailprice").alias("reference_price"))
    return rounded(ops.reference_mismatch(t.bars(spark, sf_dir), own))


@query("b8_mute_assets", f"""WITH {D}, {A}, o AS (SELECT asset, count(*) AS n, max(ts) AS last_ts, arg_max(close, ts) AS c, max(high) AS h FROM bars GROUP BY 1), m AS (SELECT max(ts) AS now FROM bars)
    SELECT a.asset, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'no bars' WHEN last_ts < now - INTERVAL 3 DAY THEN 'stale' WHEN n < 1500 THEN 'too few' WHEN c <= 0.001 * h THEN 'collapsed' END AS reason
    FROM assets a LEFT JOIN o USING (asset) CROSS JOIN m""")
def mute_assets(spark, sf_dir):
    return ops.mute(t.assets(spark, sf_dir), t.bars(spark, sf_dir), 3, 1500)


@query("b9_cascade_removal", f"""WITH {D}, s AS (SELECT asset, close / lag(close) OVER (PARTITION BY asset ORDER BY ts) AS f FROM bars WHERE close > 0),
    q AS (SELECT asset FROM s WHERE greatest(f, 1 / f) > 20 GROUP BY 1 HAVING count(*) >= 3)
    SELECT asset, ts, close FROM bars WHERE asset NOT IN (SELECT asset FROM q)""")
def cascade_removal(spark, sf_dir):
    own = t.bars(spark, sf_dir)
    return ops.without(own, ops.jumpy(own, 20.0, 3)).select("asset", "ts", "close")


@query("b10_health_counts", f"""WITH {t.TICK_SQL}, {t.bars_sql('day', 'd')}, {t.HOURLY_SQL}, {A}
    SELECT '1d' AS interval, cls, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT asset) AS n_assets FROM d JOIN assets USING (asset) GROUP BY cls
    UNION ALL SELECT '1h', NULL, count(*), min(ts), max(ts), count(DISTINCT asset) FROM bars""")
def health_counts(spark, sf_dir):
    both = t.bars(spark, sf_dir).join(t.assets(spark, sf_dir).select("asset", "cls"), "asset").select(F.lit("1d").alias("interval"), "cls", "asset", "ts")
    both = both.unionByName(t.hourly_bars(spark, sf_dir).select(F.lit("1h").alias("interval"), F.lit(None).cast("int").alias("cls"), "asset", "ts"))
    return both.groupBy("interval", "cls").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_distinct("asset").alias("n_assets"))


@query("b11_facet_counts", f"""WITH {A} SELECT 'sector' AS facet, sector AS value, count(*) AS n FROM assets WHERE sector IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'region', region, count(*) FROM assets WHERE region IS NOT NULL GROUP BY 2""")
def facet_counts(spark, sf_dir):
    return ops.facet_counts(t.assets(spark, sf_dir))
