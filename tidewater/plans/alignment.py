"""Joins, alignment and as-of (C of the inventory) and statistics on series (D)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.functions import series as f
from tidewater.operators import align as ops
from tidewater.operators.bars import log_returns
from tidewater.sources import tables as t

from .registry import query, rounded

D, A, WK = t.DAILY_SQL, t.ASSET_SQL, t.WEEKLY_SQL
TYPED = f"{t.TICK_SQL}, {t.bars_sql('day', 'bars', 'kind')}"
RET = ", ret AS (SELECT asset, ts, close, volume, CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) ELSE 0 END AS r FROM bars WINDOW w AS (PARTITION BY asset ORDER BY ts))"


@query("c1_intersect_series", f"WITH {TYPED} SELECT asset, ts, close FROM bars WHERE ts IN (SELECT ts FROM bars GROUP BY ts HAVING count(*) = (SELECT count(DISTINCT asset) FROM bars))")
def intersect_series(spark, sf_dir):
    return ops.intersect_series(t.bars(spark, sf_dir, "day", "p_type")).select("asset", "ts", "close")


GRID = ", grid AS (SELECT a.asset, g.ts, close FROM (SELECT DISTINCT asset FROM bars) a CROSS JOIN (SELECT DISTINCT ts FROM bars) g LEFT JOIN bars USING (asset, ts))"


@query("c2_forward_fill", f"WITH {D}{GRID} SELECT asset, ts, close, last_value(close IGNORE NULLS) OVER (PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING) AS filled FROM grid")
def forward_fill(spark, sf_dir):
    return ops.forward_fill(ops.densify(t.bars(spark, sf_dir)))


@query("c3_rebase", f"WITH {D} SELECT asset, ts, round(100 * close / first_value(close) OVER (PARTITION BY asset ORDER BY ts), 6) AS rebased FROM bars")
def rebase(spark, sf_dir):
    return rounded(ops.rebase(t.bars(spark, sf_dir)).select("asset", "ts", "rebased"))


@query("c4_union_grid", f"WITH {D}{GRID} SELECT asset, ts, close FROM grid")
def union_grid(spark, sf_dir):
    return ops.densify(t.bars(spark, sf_dir))


@query("c5_align_by_coverage", f"""WITH {WK}, g AS (SELECT ts FROM bars GROUP BY ts HAVING count(*) >= 0.8 * (SELECT count(DISTINCT asset) FROM bars) AND count(*) >= 2),
    k AS (SELECT asset, count(*) AS hits, (SELECT count(*) FROM g) AS points FROM bars WHERE ts IN (SELECT ts FROM g) GROUP BY 1 HAVING count(*) >= 0.9 * (SELECT count(*) FROM g) AND (SELECT count(*) FROM g) >= 200 AND arg_min(close, ts) > 0)
    SELECT k.asset, g.ts, last_value(b.close IGNORE NULLS) OVER (PARTITION BY k.asset ORDER BY g.ts ROWS UNBOUNDED PRECEDING) AS filled, round(1 - hits / points, 6) AS filled_share
    FROM k CROSS JOIN g LEFT JOIN bars b ON b.asset = k.asset AND b.ts = g.ts""")
def align_by_coverage(spark, sf_dir):
    return ops.align_by_coverage(t.bars(spark, sf_dir, "week")).withColumn("filled_share", F.round("filled_share", 6))


@query("c6_pair_join", f"WITH {WK} SELECT x.asset AS a, y.asset AS b, x.ts, x.close AS ca, y.close AS cb FROM bars x JOIN bars y ON x.ts = y.ts AND x.asset < y.asset")
def pair_join(spark, sf_dir):
    return ops.pair_join(t.bars(spark, sf_dir, "week"))


@query("c7_latest_price", f"""WITH {t.TICK_SQL}, {t.bars_sql('day', 'd')}, {t.bars_sql('hour', 'h')}, u AS (SELECT asset, ts, close, '1d' AS interval FROM d UNION ALL SELECT asset, ts, close, '1h' FROM h)
    SELECT asset, close, interval, ts FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts DESC, interval DESC) AS n FROM u WHERE close > 0) WHERE n = 1""")
def latest_price(spark, sf_dir):
    return ops.latest_price(t.bars(spark, sf_dir), t.bars(spark, sf_dir, "hour"))


def probes(spark, sf_dir):
    """Every order asks for the price of an asset at its date."""
    return t.table(spark, sf_dir, "orders").select(F.concat(F.lit("Brand#"), (F.col("o_custkey") % 25 + 1).cast("string")).alias("asset"), F.col("o_orderdate").alias("asked"), "o_orderkey")


PROBE = ", probe AS (SELECT 'Brand#' || (o_custkey % 25 + 1) AS asset, CAST(o_orderdate AS TIMESTAMP) AS asked, o_orderkey FROM orders)"


@query("c8_as_of_close", f"""WITH {D}{PROBE} SELECT p.asset, p.asked, p.o_orderkey, CASE WHEN b.ts >= p.asked - INTERVAL 4 DAY THEN b.close END AS close, CASE WHEN b.ts >= p.asked - INTERVAL 4 DAY THEN b.ts END AS close_ts
    FROM probe p ASOF LEFT JOIN bars b ON p.asset = b.asset AND p.asked >= b.ts""")
def as_of_close(spark, sf_dir):
    return ops.as_of(probes(spark, sf_dir), t.bars(spark, sf_dir), 4)


@query("c9_nth_following_bar", f"WITH {D} SELECT asset, ts, lead(close, 5) OVER (PARTITION BY asset ORDER BY ts) AS fifth FROM bars")
def nth_following(spark, sf_dir):
    return ops.following(t.bars(spark, sf_dir), 5, "fifth").select("asset", "ts", "fifth")


@query("c10_forward_by_rank", f"""WITH {D}, n AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts) AS rn FROM bars)
    SELECT x.asset, x.ts, round(y.close / x.close - 1, 6) AS fwd20 FROM n x LEFT JOIN n y ON y.asset = x.asset AND y.rn = x.rn + 20""")
def forward_by_rank(spark, sf_dir):
    own = ops.following(t.bars(spark, sf_dir), 20)
    return rounded(own.select("asset", "ts", (F.col("later") / F.col("close") - 1).alias("fwd20")))


@query("c11_calendar_forward", f"""WITH {D} SELECT asset, ts, last_value(close) OVER (PARTITION BY asset ORDER BY ts RANGE BETWEEN INTERVAL 1 SECOND FOLLOWING AND INTERVAL 10 DAY FOLLOWING) AS forward FROM bars""")
def calendar_forward(spark, sf_dir):
    return ops.calendar_forward(t.bars(spark, sf_dir), 10).select("asset", "ts", "forward")


@query("c12_nearest_in_tolerance", f"""WITH {WK}{PROBE}, m AS (SELECT p.asset, p.asked, p.o_orderkey, b.ts AS made_at, abs(epoch(b.ts) - epoch(p.asked)) AS gap FROM probe p JOIN bars b ON b.asset = p.asset AND abs(epoch(b.ts) - epoch(p.asked)) <= 3 * 86400)
    SELECT asset, asked, CAST(min(gap) AS BIGINT) AS gap_s, first(made_at ORDER BY gap, made_at) AS made_at FROM m GROUP BY 1, 2""")
def nearest_in_tolerance(spark, sf_dir):
    anchors = probes(spark, sf_dir).select("asset", "asked").distinct()
    return ops.nearest_within(anchors, t.bars(spark, sf_dir, "week").select("asset", F.col("ts").alias("made_at")), 3).select("asset", "asked", "gap_s", "made_at")


EVENT = ", ev AS (SELECT asset, i FROM (SELECT asset, ts, row_number() OVER (PARTITION BY asset ORDER BY ts) AS i, r FROM ret) WHERE abs(r) > 2)"


def big_moves(spark, sf_dir):
    own = log_returns(t.bars(spark, sf_dir)).withColumn("i", F.row_number().over(f.own()))
    return own.where(F.abs("r") > 2).select("asset", F.col("i").cast("long").alias("i"))


@query("c13_band_join", f"WITH {D}{RET}{EVENT} SELECT x.asset AS a, y.asset AS b, x.i AS ia, y.i AS ib, y.i - x.i AS lag FROM ev x JOIN ev y ON x.asset < y.asset AND abs(y.i - x.i) <= 3")
def band_join(spark, sf_dir):
    own = big_moves(spark, sf_dir)
    return ops.band_join(own, own, 3)


@query("c14_nearest_event", f"""WITH {D}{RET}{EVENT}, an AS (SELECT i FROM ev GROUP BY i HAVING count(*) >= 3),
    m AS (SELECT e.asset, e.i, an.i AS nearest, row_number() OVER (PARTITION BY e.asset, e.i ORDER BY abs(e.i - an.i), an.i) AS n FROM ev e CROSS JOIN an)
    SELECT asset, i, nearest, i - nearest AS lag, abs(i - nearest) <= 3 AS hit FROM m WHERE n = 1""")
def nearest_event(spark, sf_dir):
    own = big_moves(spark, sf_dir)
    return ops.nearest_event(own, own.groupBy("i").count().where("count >= 3").select("i"), 3)


@query("c15_semi_anti", """SELECT 'semi' AS kind, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
    UNION ALL SELECT 'anti', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def semi_anti(spark, sf_dir):
    orders, lines = t.table(spark, sf_dir, "orders").select("o_orderkey"), t.table(spark, sf_dir, "lineitem")
    semi = orders.join(lines.where("l_returnflag = 'R'").select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    anti = orders.join(lines.select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    count = lambda df, kind: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(semi, "semi").unionByName(count(anti, "anti"))


@query("c16_lateral_first", f"""SELECT c_custkey, x.o_orderkey, x.o_orderdate FROM customer LEFT JOIN LATERAL (
    SELECT o_orderkey, o_orderdate FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) x ON true""")
def lateral_first(spark, sf_dir):
    last = t.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("_x"))
    return t.table(spark, sf_dir, "customer").select("c_custkey").join(last, "c_custkey", "left").select("c_custkey", "_x.o_orderkey", "_x.o_orderdate")


@query("c17_share_of_total", "WITH s AS (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS amount FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, l_linestatus, amount, round(amount / sum(amount) OVER (), 6) AS share FROM s")
def share_of_total(spark, sf_dir):
    return rounded(ops.share_of_total(t.table(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag", "l_linestatus"]))


@query("c19_decimate_grid", f"WITH {D}, g AS (SELECT ts, ntile(300) OVER (ORDER BY ts) AS part FROM (SELECT DISTINCT ts FROM bars)) SELECT max(ts) AS ts FROM g GROUP BY part")
def decimate_grid(spark, sf_dir):
    return ops.decimate(t.bars(spark, sf_dir), 300)


@query("c20_resolve_range", """SELECT o_orderkey, greatest(least(o_orderdate, TIMESTAMP '1998-06-15'), CAST(CAST(greatest(o_orderdate, TIMESTAMP '1998-06-15') AS DATE) - INTERVAL 12 MONTH AS TIMESTAMP)) AS from_ts,
    greatest(o_orderdate, TIMESTAMP '1998-06-15') AS to_ts FROM orders""")
def resolve_range(spark, sf_dir):
    orders = t.table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", ops.resolve_range(F.col("o_orderdate"), F.lit("1998-06-15").cast("timestamp"), 12).alias("_r")).select("o_orderkey", "_r.from_ts", "_r.to_ts")


@query("c21_chart_series", f"""WITH {D}{GRID}, x AS (SELECT asset, ts, last_value(close IGNORE NULLS) OVER w AS filled FROM grid WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING)),
    k AS (SELECT max(ts) AS ts FROM (SELECT ts, ntile(200) OVER (ORDER BY ts) AS part FROM (SELECT DISTINCT ts FROM bars)) GROUP BY part)
    SELECT asset, ts, round(filled, 6) AS close, round(100 * filled / first_value(filled IGNORE NULLS) OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) AS rebased FROM x WHERE ts IN (SELECT ts FROM k) AND filled IS NOT NULL""")
def chart_series(spark, sf_dir):
    own = t.bars(spark, sf_dir)
    filled = ops.forward_fill(ops.densify(own)).join(F.broadcast(ops.decimate(own, 200)), "ts", "left_semi").where("filled IS NOT NULL")
    return rounded(ops.rebase(filled.select("asset", "ts", F.col("filled").alias("close"))))


@query("d1_log_returns", f"WITH {D}{RET} SELECT asset, ts, round(r, 6) AS r FROM ret")
def log_return_query(spark, sf_dir):
    return rounded(log_returns(t.bars(spark, sf_dir)).select("asset", "ts", "r"))


@query("d2_mean_deviation", f"WITH {D}{RET} SELECT asset, round(avg(r), 6) AS mean_r, round(coalesce(stddev_samp(r), 0), 6) AS sd_r, count(*) AS n FROM ret GROUP BY 1")
def mean_deviation(spark, sf_dir):
    own = log_returns(t.bars(spark, sf_dir)).groupBy("asset").agg(F.avg("r").alias("mean_r"), f.sample_deviation(F.col("r")).alias("sd_r"), F.count(F.lit(1)).alias("n"))
    return rounded(own)


PAIR_RET = ", pr AS (SELECT x.asset AS a, y.asset AS b, x.ts, x.r AS ra, y.r AS rb FROM ret x JOIN ret y ON x.ts = y.ts AND x.asset < y.asset)"


def pair_returns(spark, sf_dir, unit="week"):
    own = log_returns(t.bars(spark, sf_dir, unit))
    left, right = own.select(F.col("asset").alias("a"), "ts", F.col("r").alias("ra")), own.select(F.col("asset").alias("b"), "ts", F.col("r").alias("rb"))
    return left.join(right, "ts").where("a < b")


@query("d3_correlation", f"WITH {WK}{RET}{PAIR_RET} SELECT a, b, round(CASE WHEN count(*) < 3 THEN 0 ELSE coalesce(corr(ra, rb), 0) END, 6) AS r, count(*) AS n FROM pr GROUP BY 1, 2")
def correlation(spark, sf_dir):
    return rounded(pair_returns(spark, sf_dir).groupBy("a", "b").agg(f.correlation("ra", "rb").alias("r"), F.count(F.lit(1)).alias("n")))


LAGGED = """, n AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY ts) AS i FROM pr), k AS (SELECT unnest(range(-5, 6)) AS lag),
    cc AS (SELECT x.a, x.b, k.lag, coalesce(CASE WHEN count(*) < 3 THEN 0 ELSE corr(x.ra, y.rb) END, 0) AS r FROM n x CROSS JOIN k JOIN n y ON y.a = x.a AND y.b = x.b AND y.i = x.i + k.lag GROUP BY 1, 2, 3)"""


def lag_correlations(spark, sf_dir):
    from tidewater.operators.pairs import cross_correlation

    return cross_correlation(pair_returns(spark, sf_dir), 5)


@query("d4_cross_correlation", f"WITH {WK}{RET}{PAIR_RET}{LAGGED} SELECT a, b, lag, round(r, 6) AS r FROM cc")
def cross_correlation_query(spark, sf_dir):
    return rounded(lag_correlations(spark, sf_dir))


@query("d5_best_lag", f"WITH {WK}{RET}{PAIR_RET}{LAGGED} SELECT a, b, lag, round(r, 6) AS r FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY round(abs(r), 9) DESC, lag) AS n FROM cc) WHERE n = 1")
def best_lag_query(spark, sf_dir):
    from tidewater.operators.pairs import best_lag

    return rounded(best_lag(lag_correlations(spark, sf_dir)))


@query("d6_beta", f"WITH {WK}{RET}{PAIR_RET} SELECT a, b, round(CASE WHEN count(*) < 3 THEN 0 ELSE coalesce(regr_slope(rb, ra), 0) END, 6) AS beta FROM pr GROUP BY 1, 2")
def beta(spark, sf_dir):
    return rounded(pair_returns(spark, sf_dir).groupBy("a", "b").agg(f.slope("rb", "ra").alias("beta")))


@query("d7_ewma", f"""WITH RECURSIVE {WK}, n AS (SELECT asset, ts, close, row_number() OVER (PARTITION BY asset ORDER BY ts) AS i FROM bars),
    e AS (SELECT asset, i, ts, close AS ewma FROM n WHERE i = 1 UNION ALL SELECT n.asset, n.i, n.ts, 0.2 * n.close + 0.8 * e.ewma FROM e JOIN n ON n.asset = e.asset AND n.i = e.i + 1)
    SELECT asset, ts, round(ewma, 4) AS ewma FROM e""")
def ewma_query(spark, sf_dir):
    from tidewater.operators.curve import smooth

    return rounded(smooth(t.bars(spark, sf_dir, "week"), "close", 0.2).select("asset", "ts", F.col("smoothed").alias("ewma")), 4)


@query("d8_running_mean", f"WITH {D} SELECT asset, ts, round(avg(close) OVER (PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING), 4) AS running FROM bars")
def running_mean(spark, sf_dir):
    return rounded(t.bars(spark, sf_dir).select("asset", "ts", F.avg("close").over(f.own().rowsBetween(Window.unboundedPreceding, 0)).alias("running")), 4)


@query("d9_own_bar_returns", f"""WITH {D} SELECT asset, ts, round(CASE WHEN lag(close, 5) OVER w > 0 THEN ln(close / lag(close, 5) OVER w) END, 6) AS back5, round(ln(lead(close, 5) OVER w / close), 6) AS ahead5
    FROM bars WHERE close > 0 WINDOW w AS (PARTITION BY asset ORDER BY ts)""")
def own_bar_returns(spark, sf_dir):
    w = f.own()
    return rounded(t.bars(spark, sf_dir).where("close > 0").select("asset", "ts", F.ln(F.col("close") / F.lag("close", 5).over(w)).alias("back5"), F.ln(F.lead("close", 5).over(w) / F.col("close")).alias("ahead5")))


@query("d10_rolling_moments", f"""WITH {D}{RET} SELECT asset, ts, round(CASE WHEN count(r) OVER w20 >= 5 THEN stddev_samp(r) OVER w20 END, 6) AS vol20, round(close / avg(close) OVER w50 - 1, 6) AS ma_distance50,
    round(CASE WHEN count(*) OVER w50 >= 10 AND stddev_samp(close) OVER w50 > 0 THEN (close - avg(close) OVER w50) / stddev_samp(close) OVER w50 END, 6) AS z50 FROM ret
    WINDOW w20 AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), w50 AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""")
def rolling_moments(spark, sf_dir):
    w20, w50 = f.last_rows(20), f.last_rows(50)
    mean, sd = F.avg("close").over(w50), F.stddev_samp("close").over(w50)
    own = log_returns(t.bars(spark, sf_dir)).select(
        "asset", "ts", F.when(F.count("r").over(w20) >= 5, F.stddev_samp("r").over(w20)).alias("vol20"), (F.col("close") / mean - 1).alias("ma_distance50"),
        F.when((F.count(F.lit(1)).over(w50) >= 10) & (sd > 0), F.try_divide(F.col("close") - mean, sd)).alias("z50"),
    )
    return rounded(own)


@query("d11_spearman", f"""WITH {D}, k AS (SELECT asset, rank() OVER (PARTITION BY asset ORDER BY volume) + (count(*) OVER (PARTITION BY asset, volume) - 1) / 2 AS rx, rank() OVER (PARTITION BY asset ORDER BY close) + (count(*) OVER (PARTITION BY asset, close) - 1) / 2 AS ry FROM bars)
    SELECT asset, round(corr(rx, ry), 6) AS rho FROM k GROUP BY 1""")
def spearman_query(spark, sf_dir):
    from tidewater.operators.pairs import spearman

    return rounded(spearman(t.bars(spark, sf_dir), "volume", "close"))


@query("d12_regression_threshold", f"""WITH {D}{RET}, x AS (SELECT asset, r, lead(r) OVER (PARTITION BY asset ORDER BY ts) AS nxt FROM ret)
    SELECT asset, round(corr(r, nxt), 6) AS r, round(regr_slope(nxt, r), 6) AS slope, count(*) AS n, round(2 / sqrt(count(*)), 6) AS threshold FROM x WHERE nxt IS NOT NULL GROUP BY 1""")
def regression_threshold(spark, sf_dir):
    own = log_returns(t.bars(spark, sf_dir)).select("asset", "r", F.lead("r").over(f.own()).alias("nxt")).where("nxt IS NOT NULL")
    return rounded(own.groupBy("asset").agg(f.correlation("r", "nxt").alias("r"), f.slope("nxt", "r").alias("slope"), F.count(F.lit(1)).alias("n"), (2 / F.sqrt(F.count(F.lit(1)))).alias("threshold")))
