"""Pairs, lead-lag and crossings (E of the inventory)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.operators import align, pairs as ops
from tidewater.sources import tables as t

from .alignment import D, A, WK
from .registry import query, rounded

CLOSES = ", cl AS (SELECT x.asset AS a, y.asset AS b, x.ts, x.close AS ca, y.close AS cb FROM bars x JOIN bars y ON x.ts = y.ts AND x.asset < y.asset)"
STATS = """, pr0 AS (SELECT a, b, ts, row_number() OVER w AS i, CASE WHEN ca > 0 AND lag(ca) OVER w > 0 THEN ln(ca / lag(ca) OVER w) ELSE 0 END AS ra, CASE WHEN cb > 0 AND lag(cb) OVER w > 0 THEN ln(cb / lag(cb) OVER w) ELSE 0 END AS rb FROM cl WINDOW w AS (PARTITION BY a, b ORDER BY ts)),
    pr AS (SELECT * FROM pr0 WHERE i > 1), p0 AS (SELECT a, b, coalesce(corr(ra, rb), 0) AS corr0, count(*) + 1 AS n FROM pr GROUP BY 1, 2 HAVING count(*) + 1 >= 60),
    k AS (SELECT unnest(range(-12, 13)) AS lag),
    cc AS (SELECT x.a, x.b, k.lag, coalesce(CASE WHEN count(*) < 3 THEN 0 ELSE corr(x.ra, y.rb) END, 0) AS r FROM p0 JOIN pr x ON x.a = p0.a AND x.b = p0.b AND abs(round(p0.corr0, 9)) >= {thr} CROSS JOIN k JOIN pr y ON y.a = x.a AND y.b = x.b AND y.i = x.i + k.lag GROUP BY 1, 2, 3),
    bl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY round(abs(r), 9) DESC, lag) AS m FROM cc) WHERE m = 1),
    ps AS (SELECT p0.a, p0.b, p0.n, p0.corr0, coalesce(bl.lag, 0) AS lag, coalesce(bl.r, p0.corr0) AS lag_corr FROM p0 LEFT JOIN bl ON bl.a = p0.a AND bl.b = p0.b)"""
W_STATS = f"WITH {WK}{CLOSES}{STATS.format(thr=0.05)}"


def closes(spark, sf_dir, unit="week"):
    return align.pair_join(t.bars(spark, sf_dir, unit))


def stats(spark, sf_dir, bars=None):
    return ops.pair_statistics(closes(spark, sf_dir) if bars is None else align.pair_join(bars), threshold=0.05)


@query("e1_pair_stats", f"WITH {D}{CLOSES}{STATS.format(thr=0.15)} SELECT a, b, n, round(corr0, 6) AS corr0, lag, round(lag_corr, 6) AS lag_corr FROM ps")
def pair_stats(spark, sf_dir):
    return rounded(ops.pair_statistics(closes(spark, sf_dir, "day")))


@query("e1_weekly_pair_stats", f"{W_STATS} SELECT a, b, n, round(corr0, 6) AS corr0, lag, round(lag_corr, 6) AS lag_corr FROM ps")
def weekly_pair_stats(spark, sf_dir):
    return rounded(stats(spark, sf_dir))


CROSS = """, sp AS (SELECT a, b, ts, 100 * ca / first_value(ca) OVER w - 100 * cb / first_value(cb) OVER w AS s FROM cl WINDOW w AS (PARTITION BY a, b ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    s1 AS (SELECT *, abs(s) >= 0.5 AS big, max(CASE WHEN abs(s) >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY a, b ORDER BY ts) AS seen FROM sp),
    s2 AS (SELECT *, coalesce(CASE WHEN sign(s) <> sign(lag(s) OVER (PARTITION BY a, b ORDER BY ts)) THEN 1 ELSE 0 END, 0) AS flip FROM s1 WHERE seen = 1 AND s <> 0),
    s3 AS (SELECT *, sum(flip) OVER (PARTITION BY a, b ORDER BY ts) AS run FROM s2),
    s4 AS (SELECT *, last_value(CASE WHEN big THEN run END IGNORE NULLS) OVER (PARTITION BY a, b ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS brun, last_value(CASE WHEN big THEN s END IGNORE NULLS) OVER (PARTITION BY a, b ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bs FROM s3),
    cr AS (SELECT a, b, ts, CASE WHEN s > 0 THEN 1 ELSE 0 END AS direction, bs AS spread_before, s AS spread_after FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY ts) AS m FROM s4 WHERE flip = 1 AND big AND brun = run - 1) WHERE m <= 40)"""


def found(spark, sf_dir, unit="week"):
    return ops.crossings(closes(spark, sf_dir, unit))


@query("e2_crossings", f"WITH {D}{CLOSES}{CROSS} SELECT a, b, ts, direction, round(spread_before, 4) AS spread_before, round(spread_after, 4) AS spread_after FROM cr")
def crossings(spark, sf_dir):
    return rounded(found(spark, sf_dir, "day"), 4)


@query("e3_average_crosses", f"""WITH {D}, g AS (SELECT asset, ts, CASE WHEN row_number() OVER (PARTITION BY asset ORDER BY ts) >= 50 THEN avg(close) OVER (PARTITION BY asset ORDER BY ts ROWS 19 PRECEDING) - avg(close) OVER (PARTITION BY asset ORDER BY ts ROWS 49 PRECEDING) END AS gap FROM bars),
    x AS (SELECT *, lag(gap) OVER (PARTITION BY asset ORDER BY ts) AS was FROM g)
    SELECT asset, ts, CASE WHEN was <= 0 AND gap > 0 THEN 1 ELSE -1 END AS "cross" FROM x WHERE (was <= 0 AND gap > 0) OR (was >= 0 AND gap < 0)""")
def average_crosses(spark, sf_dir):
    return ops.average_crosses(t.bars(spark, sf_dir), 20, 50)


BOTH = "SELECT a AS asset, b AS other, corr0 AS r, lag, lag_corr, n FROM ps UNION ALL SELECT b, a, corr0, -lag, lag_corr, n FROM ps"


@query("e4_correlations_of_asset", f"{W_STATS} SELECT other, round(r, 6) AS r, lag FROM ({BOTH}) WHERE asset = 'Brand#12'")
def correlations_of_asset(spark, sf_dir):
    return rounded(ops.mirrored(stats(spark, sf_dir)).where("asset = 'Brand#12'").orderBy(F.desc(F.abs("r"))).select("other", "r", "lag"))


LEAD = f", ld AS (SELECT asset, other AS leader, -lag AS lag, lag_corr, row_number() OVER (PARTITION BY asset ORDER BY round(abs(lag_corr), 9) DESC, other) AS place FROM ({BOTH}) WHERE lag < 0)"


@query("e5_top_leaders", f"{W_STATS}{LEAD} SELECT asset, leader, lag, round(lag_corr, 6) AS lag_corr, place FROM ld WHERE place <= 5")
def top_leaders(spark, sf_dir):
    return rounded(ops.leaders(stats(spark, sf_dir), 5))


@query("e6_correlation_matrix", f"{W_STATS} SELECT asset, other, round(r, 6) AS r, lag FROM ({BOTH}) UNION ALL SELECT asset, asset, 1, 0 FROM (SELECT DISTINCT asset FROM bars)")
def correlation_matrix(spark, sf_dir):
    diagonal = t.bars(spark, sf_dir, "week").select("asset").distinct().select("asset", F.col("asset").alias("other"), F.lit(1.0).alias("r"), F.lit(0).alias("lag"))
    return rounded(ops.mirrored(stats(spark, sf_dir)).select("asset", "other", "r", "lag").unionByName(diagonal))


@query("e7_extreme_pairs", f"""{W_STATS}{CROSS}, n AS (SELECT a, b, count(*) AS crosses FROM cr GROUP BY 1, 2)
    SELECT * FROM (SELECT 'negative' AS mode, a, b, round(corr0, 6) AS value FROM ps ORDER BY round(corr0, 9), a, b LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'positive', a, b, round(corr0, 6) FROM ps ORDER BY round(corr0, 9) DESC, a, b LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'lead', a, b, round(lag_corr, 6) FROM ps WHERE lag <> 0 ORDER BY round(abs(lag_corr), 9) DESC, a, b LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'crossings', a, b, CAST(crosses AS DOUBLE) FROM n ORDER BY crosses DESC, a, b LIMIT 10)""")
def extreme_pairs(spark, sf_dir):
    own = stats(spark, sf_dir)
    count = found(spark, sf_dir).groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("value"))

    def top(df, mode, value, order):
        return df.orderBy(order, "a", "b").limit(10).select(F.lit(mode).alias("mode"), "a", "b", value.alias("value"))

    r9 = F.round("corr0", 9)
    out = top(own, "negative", F.col("corr0"), r9).unionByName(top(own, "positive", F.col("corr0"), F.desc(r9)))
    out = out.unionByName(top(own.where("lag <> 0"), "lead", F.col("lag_corr"), F.desc(F.round(F.abs("lag_corr"), 9))))
    return rounded(out.unionByName(top(count, "crossings", F.col("value"), F.desc("value"))))


@query("e8_recent_crossings", f"WITH {WK}{CLOSES}{CROSS} SELECT a, b, ts, direction FROM cr WHERE ts >= (SELECT max(ts) FROM bars) - INTERVAL 120 DAY ORDER BY ts DESC, a, b LIMIT 100")
def recent_crossings(spark, sf_dir):
    now = t.bars(spark, sf_dir, "week").agg(F.max("ts").alias("_now"))
    own = found(spark, sf_dir).join(F.broadcast(now)).where(F.col("ts") >= F.col("_now") - F.expr("INTERVAL 120 DAYS"))
    return own.orderBy(F.desc("ts"), "a", "b").limit(100).select("a", "b", "ts", "direction")


SINCE = "TIMESTAMP '2000-01-01 00:00:00'"
OPP = f""", la AS (SELECT a, b, max(ts) AS ts, arg_max(direction, ts) AS direction FROM cr WHERE ts >= {SINCE} GROUP BY 1, 2), ll AS (SELECT a, b, arg_max(ca, ts) AS la, arg_max(cb, ts) AS lb FROM cl GROUP BY 1, 2),
    op AS (SELECT la.a, la.b, la.ts, la.direction, ll.la / cl.ca - 1 AS ret_a, ll.lb / cl.cb - 1 AS ret_b FROM la JOIN cl ON cl.a = la.a AND cl.b = la.b AND cl.ts = la.ts JOIN ll ON ll.a = la.a AND ll.b = la.b)"""
GAIN = "CASE WHEN direction = 1 THEN ret_a - ret_b ELSE ret_b - ret_a END"
MOST_JUMP = 5.5


def open_pairs(spark, sf_dir):
    own = closes(spark, sf_dir)
    return ops.opportunities(ops.crossings(own), own, F.expr(SINCE))


@query("e9_crossing_opportunities", f"WITH {WK}{CLOSES}{CROSS}{OPP} SELECT a, b, ts, direction, round(ret_a, 6) AS ret_a, round(ret_b, 6) AS ret_b, round({GAIN}, 6) AS pair_gain FROM op")
def crossing_opportunities(spark, sf_dir):
    return rounded(open_pairs(spark, sf_dir))


@query("e9_class_switches", f"""WITH {WK}{CLOSES}{CROSS}{OPP}, {A}, jm AS (SELECT asset, max(m) AS jump FROM (SELECT asset, ts, abs(ln(close / lag(close) OVER (PARTITION BY asset ORDER BY ts))) AS m FROM bars WHERE close > 0) WHERE ts >= {SINCE} GROUP BY 1)
    SELECT a, b, ts, direction, round({GAIN}, 6) AS pair_gain, round(greatest(x.jump, y.jump), 6) AS max_jump FROM op JOIN assets p ON p.asset = a JOIN assets q ON q.asset = b JOIN jm x ON x.asset = a JOIN jm y ON y.asset = b WHERE (p.cls = 2) <> (q.cls = 2) AND greatest(x.jump, y.jump) < {MOST_JUMP}""")
def class_switches(spark, sf_dir):
    """Opportunities that lead into or out of the crypto class, without assets whose price has jumped; the test prices jump by e to the fifth and more."""
    week = t.bars(spark, sf_dir, "week")
    jumps = ops.jump_guard(week.where("close > 0").withColumn("cls", F.lit(0)), F.expr(SINCE), F.lit(MOST_JUMP)).where("NOT suspect").select("asset", "max_move")
    return rounded(ops.class_switches(open_pairs(spark, sf_dir), t.assets(spark, sf_dir), jumps).select("a", "b", "ts", "direction", "pair_gain", "max_jump"))


@query("e10_jump_guard", f"""WITH {D}, {A}, m AS (SELECT asset, ts, abs(CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) ELSE 0 END) AS m FROM bars WINDOW w AS (PARTITION BY asset ORDER BY ts))
    SELECT asset, cls, round(max(m), 6) AS max_move, max(m) >= CASE WHEN cls = 2 THEN 0.9 ELSE 0.4 END AS suspect FROM m JOIN assets USING (asset) WHERE ts >= {SINCE} GROUP BY 1, 2""")
def jump_guard(spark, sf_dir):
    own = t.bars(spark, sf_dir).join(t.assets(spark, sf_dir).select("asset", "cls"), "asset")
    return rounded(ops.jump_guard(own, F.expr(SINCE), F.when(F.col("cls") == 2, 0.9).otherwise(0.4)))


@query("e11_capped_ranking", f"""WITH RECURSIVE {WK}{CLOSES}{CROSS}{OPP}, rk AS MATERIALIZED (SELECT * FROM (SELECT a, b, {GAIN} AS score, row_number() OVER (ORDER BY {GAIN} DESC, a, b) AS i FROM op) WHERE i <= 4000),
    wk AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS used, NULL::VARCHAR AS a, NULL::VARCHAR AS b, NULL::DOUBLE AS score, false AS kept UNION ALL
      SELECT i, CASE WHEN kept THEN used || [a, b] ELSE used END, a, b, score, kept FROM (SELECT rk.i, used, rk.a, rk.b, rk.score, len(list_filter(used, lambda u: u = rk.a)) < 2 AND len(list_filter(used, lambda u: u = rk.b)) < 2 AS kept FROM wk JOIN rk ON rk.i = wk.i + 1))
    SELECT CAST(row_number() OVER (ORDER BY i) AS INT) AS place, a, b, round(score, 6) AS score FROM wk WHERE kept""")
def capped_ranking(spark, sf_dir):
    return rounded(ops.capped_ranking(open_pairs(spark, sf_dir).select("a", "b", F.col("pair_gain").alias("score")), 4000, 2))


GAINS = """, fwd AS (SELECT a, b, ts, lead(ca, 10) OVER (PARTITION BY a, b ORDER BY ts) / ca - 1 AS fa, lead(cb, 10) OVER (PARTITION BY a, b ORDER BY ts) / cb - 1 AS fb FROM cl),
    gn AS (SELECT cr.a, cr.b, CASE WHEN direction = 1 THEN fa - fb ELSE fb - fa END AS gain FROM cr JOIN fwd ON fwd.a = cr.a AND fwd.b = cr.b AND fwd.ts = cr.ts WHERE fa IS NOT NULL AND cr.ts < """ + SINCE + ")"
RECORD = """ SELECT a, b, count(*) AS n, round(avg(CASE WHEN gain > 0 THEN 1.0 ELSE 0 END), 6) AS hit_rate, round(avg(gain), 6) AS mean_gain,
    count(*) >= 8 AND avg(CASE WHEN gain > 0 THEN 1.0 ELSE 0 END) >= 0.55 AND avg(gain) - 0.003 > 0 AS proven FROM gn GROUP BY 1, 2"""


def record(spark, sf_dir):
    own = closes(spark, sf_dir)
    return ops.track_record(ops.forward_gains(ops.crossings(own).where(f"ts < {SINCE}"), own, 10), 0.003)


@query("e12_crossing_track_record", f"WITH {WK}{CLOSES}{CROSS}{GAINS}{RECORD}")
def crossing_track_record(spark, sf_dir):
    return rounded(record(spark, sf_dir))


@query("e13_proven_pairs", f"WITH {WK}{CLOSES}{CROSS}{GAINS} SELECT a, b, n FROM ({RECORD}) WHERE proven")
def proven_pairs(spark, sf_dir):
    return record(spark, sf_dir).where("proven").select("a", "b", "n")


AGAINST = "SELECT a, b, count(*) AS n, round(avg(CASE WHEN gain < 0 THEN 1.0 ELSE 0 END), 6) AS hit_rate, round(-avg(gain), 6) AS mean_gain FROM gn GROUP BY 1, 2 HAVING count(*) >= 8 AND avg(CASE WHEN gain < 0 THEN 1.0 ELSE 0 END) >= 0.55 AND -avg(gain) - 0.003 > 0"


@query("e13_proven_against", f"WITH {WK}{CLOSES}{CROSS}{GAINS} {AGAINST}")
def proven_against(spark, sf_dir):
    """The same test for the trade against the crossing: prices that revert prove this one."""
    own = closes(spark, sf_dir)
    gains = ops.forward_gains(ops.crossings(own).where(f"ts < {SINCE}"), own, 10).withColumn("gain", -F.col("gain"))
    return rounded(ops.track_record(gains, 0.003).where("proven").drop("proven"))


@query("e14_swap_suggestions", f"""WITH {WK}{CLOSES}{CROSS}{OPP}, {A}, h AS (SELECT asset FROM assets WHERE cap_rank <= 8), s AS (
      SELECT CASE WHEN direction = 1 THEN b ELSE a END AS held, CASE WHEN direction = 1 THEN a ELSE b END AS instead, CASE WHEN direction = 1 THEN ret_b ELSE ret_a END AS ret_held, CASE WHEN direction = 1 THEN ret_a ELSE ret_b END AS ret_instead FROM op),
    k AS (SELECT *, row_number() OVER (PARTITION BY held ORDER BY round(ret_instead, 9) DESC, instead) AS place FROM s WHERE held IN (SELECT asset FROM h) AND ret_instead > ret_held)
    SELECT held, instead, place, round(1000 * (1 + ret_held), 4) AS kept_worth, round(1000 * (1 + ret_instead), 4) AS swapped_worth FROM k WHERE place <= 3""")
def swap_suggestions(spark, sf_dir):
    up = F.col("direction") == 1
    own = open_pairs(spark, sf_dir).select(F.when(up, F.col("b")).otherwise(F.col("a")).alias("held"), F.when(up, F.col("a")).otherwise(F.col("b")).alias("instead"), F.when(up, F.col("ret_b")).otherwise(F.col("ret_a")).alias("ret_held"), F.when(up, F.col("ret_a")).otherwise(F.col("ret_b")).alias("ret_instead"))
    holdings = t.assets(spark, sf_dir).where("cap_rank <= 8").select(F.col("asset").alias("held"))
    better = own.join(holdings, "held", "left_semi").where("ret_instead > ret_held")
    better = better.withColumn("place", F.row_number().over(Window.partitionBy("held").orderBy(F.desc(F.round("ret_instead", 9)), "instead"))).where("place <= 3")
    return rounded(better.select("held", "instead", "place", (1000 * (1 + F.col("ret_held"))).alias("kept_worth"), (1000 * (1 + F.col("ret_instead"))).alias("swapped_worth")), 4)


#: When the exchanges of a region open first and close last, in hours of the day (UTC).
HOURS = {"ASIA": (0, 8), "EURO": (7, 16), "AMER": (13, 20)}
STUDY = """, fw AS (SELECT asset, ts, last_value(close) OVER (PARTITION BY asset ORDER BY ts RANGE BETWEEN INTERVAL 1 SECOND FOLLOWING AND INTERVAL 30 DAY FOLLOWING) / close - 1 AS fw FROM bars),
    rg AS (SELECT cr.a, cr.b, CASE WHEN direction = 1 THEN x.fw - y.fw ELSE y.fw - x.fw END AS gain FROM cr JOIN fw x ON x.asset = cr.a AND x.ts = cr.ts JOIN fw y ON y.asset = cr.b AND y.ts = cr.ts WHERE x.fw IS NOT NULL AND y.fw IS NOT NULL),
    st AS (SELECT a, b, count(*) AS n, count(*) FILTER (gain > 0) AS hits, avg(gain) AS mean_gain, (count(*) FILTER (gain > 0) - count(*) / 2) / sqrt(count(*) / 4) AS z FROM rg GROUP BY 1, 2 HAVING count(*) >= 10)"""


def reversal(spark, sf_dir):
    own = t.bars(spark, sf_dir, "week")
    forwards = align.calendar_forward(own, 30).select("asset", "ts", (F.col("forward") / F.col("close") - 1).alias("fw"))
    return ops.reversal_study(ops.crossings(align.pair_join(own)), forwards, 10)


@query("e15_reversal_study", f"WITH {WK}{CLOSES}{CROSS}{STUDY} SELECT a, b, n, hits, round(mean_gain, 6) AS mean_gain, round(z, 6) AS z FROM st")
def reversal_study(spark, sf_dir):
    return rounded(reversal(spark, sf_dir))


@query("e15_reversal_summary", f"WITH {WK}{CLOSES}{CROSS}{STUDY} SELECT count(*) AS n_pairs, count(*) FILTER (z >= 1.96) AS n_high, count(*) FILTER (z <= -1.96) AS n_low, round(0.025 * count(*), 6) AS expected_each FROM st")
def reversal_summary(spark, sf_dir):
    return rounded(ops.reversal_summary(reversal(spark, sf_dir)))


MOMENT = "(avg({x} * {y}) - avg({x}) * avg({y})) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


@query("e16_region_lead", f"""WITH {D}, {A}, q AS (SELECT region, CAST(ts AS DATE) AS day, ln(close / lag(close) OVER w) AS cc, ln(open / lag(close) OVER w) AS gap, ln(close / open) AS oc FROM bars JOIN assets USING (asset) WHERE close > 0 AND open > 0 WINDOW w AS (PARTITION BY asset ORDER BY ts)),
    g AS (SELECT region, day, count(*) AS members, avg(cc) AS cc, avg(gap) AS gap, avg(oc) AS oc FROM q WHERE cc IS NOT NULL AND gap IS NOT NULL AND oc IS NOT NULL GROUP BY 1, 2), z(region, opens, closes) AS (VALUES {", ".join(f"('{r}', {o}, {c})" for r, (o, c) in HOURS.items())})
    SELECT f.region AS early, s.region AS late, any_value(sz.closes - fz.closes) AS hours, count(*) AS n, round(avg(f.members), 6) AS early_members, round(avg(s.members), 6) AS late_members, {", ".join(f"round({MOMENT.format(x='f.cc', y=y)}, 6) AS r_{n}" for n, y in (("cc", "s.cc"), ("gap", "s.gap"), ("oc", "s.oc")))},
      round((avg(b.cc * f.cc) - avg(b.cc) * avg(f.cc)) / nullif(stddev_pop(b.cc) * stddev_pop(f.cc), 0), 6) AS r_counter, any_value(greatest(0, fz.closes - sz.opens)) AS overlap
    FROM g f JOIN g s ON s.day = f.day JOIN z fz ON fz.region = f.region JOIN z sz ON sz.region = s.region LEFT JOIN g b ON b.region = s.region AND b.day = f.day - 1 WHERE sz.closes > fz.closes GROUP BY 1, 2 HAVING count(*) >= 200""")
def region_lead(spark, sf_dir):
    hours = spark.createDataFrame([(r, o, c) for r, (o, c) in HOURS.items()], "region string, opens int, closes int")
    return rounded(ops.region_lead(t.bars(spark, sf_dir), t.assets(spark, sf_dir).select("asset", "region"), hours, 200))



@query("a6_pair_stat_upsert", f"""{W_STATS}, old AS (SELECT a, b, n, round(corr0, 6) AS corr0 FROM ps WHERE a < 'Brand#2'), fresh AS (SELECT a, b, n + 1 AS n, round(-corr0, 6) AS corr0 FROM ps WHERE b >= 'Brand#2')
    SELECT coalesce(f.a, o.a) AS a, coalesce(f.b, o.b) AS b, coalesce(f.n, o.n) AS n, coalesce(f.corr0, o.corr0) AS corr0 FROM old o FULL JOIN fresh f ON f.a = o.a AND f.b = o.b""")
def pair_stat_upsert(spark, sf_dir):
    from tidewater.operators.bars import upsert

    own = stats(spark, sf_dir)
    old = own.where("a < 'Brand#2'").select("a", "b", "n", F.round("corr0", 6).alias("corr0"))
    fresh = own.where("b >= 'Brand#2'").select("a", "b", (F.col("n") + 1).alias("n"), F.round(-F.col("corr0"), 6).alias("corr0"))
    return upsert(old, fresh, ["a", "b"])


@query("l6_reversal_report", f"WITH {WK}{CLOSES}{CROSS}{STUDY} SELECT a, b, n, round(hits / n, 6) AS hit_rate, round(1.96 / sqrt(n), 6) AS threshold, abs(hits / n - 0.5) > 0.5 * 1.96 / sqrt(n) AS significant FROM st")
def reversal_report(spark, sf_dir):
    hit, threshold = F.col("hits") / F.col("n"), 1.96 / F.sqrt("n")
    return rounded(reversal(spark, sf_dir).select("a", "b", "n", hit.alias("hit_rate"), threshold.alias("threshold"), (F.abs(hit - 0.5) > 0.5 * threshold).alias("significant")))


@query("c18_region_order", f"""WITH {A}, r AS (SELECT region, CASE region WHEN 'ASIA' THEN 6 WHEN 'EURO' THEN 16 ELSE 21 END AS closes, count(*) AS n FROM assets GROUP BY 1)
    SELECT e.region AS early, l.region AS late, l.closes - e.closes AS hours, e.n AS n_early, l.n AS n_late FROM r e JOIN r l ON e.region <> l.region AND l.closes > e.closes""")
def region_order(spark, sf_dir):
    regions = t.assets(spark, sf_dir).groupBy("region").agg(F.count(F.lit(1)).alias("n")).withColumn("closes", F.when(F.col("region") == "ASIA", 6).when(F.col("region") == "EURO", 16).otherwise(21))
    e, late = regions.alias("e"), regions.alias("l")
    met = e.join(late, F.expr("e.region <> l.region AND l.closes > e.closes"))
    return met.select(F.col("e.region").alias("early"), F.col("l.region").alias("late"), F.expr("l.closes - e.closes").alias("hours"), F.col("e.n").alias("n_early"), F.col("l.n").alias("n_late"))
