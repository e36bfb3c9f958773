"""Capital flow (F of the inventory)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.operators import align, flow as ops
from tidewater.sources import tables as t

from .alignment import D, RET
from .registry import query, rounded

A = t.ASSET_SQL
FLOW = """, fl AS (SELECT asset, ts, cls, open, high, low, close, volume, CASE WHEN volume > 0 THEN CASE WHEN cls = 2 THEN volume ELSE close * volume END END AS gross FROM bars JOIN assets USING (asset)),
    fn AS (SELECT *, gross * CASE WHEN high > low THEN greatest(-1, least(1, ((close - low) - (high - close)) / (high - low))) ELSE coalesce(sign(close - open), 0) END AS net FROM fl)"""
W = f"WITH {D}, {A}{FLOW}"


def flow(spark, sf_dir, bars=None):
    return ops.with_flow(t.bars(spark, sf_dir) if bars is None else bars, t.assets(spark, sf_dir))


@query("f1_money_flow", f"{W} SELECT asset, ts, gross FROM fn")
def money_flow(spark, sf_dir):
    return flow(spark, sf_dir).select("asset", "ts", "gross")


@query("f2_share_rotation", f"""{W}, s AS (SELECT asset, ts, gross / sum(gross) OVER (PARTITION BY ts) AS share FROM fn)
    SELECT asset, ts, round(share, 6) AS share, round(share / avg(share) OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) - 1, 6) AS rotation FROM s""")
def share_rotation(spark, sf_dir):
    return rounded(ops.shares(flow(spark, sf_dir)).select("asset", "ts", "share", "rotation"))


@query("f3_volume_z", f"""WITH {D} SELECT asset, ts, round(CASE WHEN count(volume) OVER w >= 5 AND stddev_samp(volume) OVER w > 0 THEN (volume - avg(volume) OVER w) / stddev_samp(volume) OVER w ELSE 0 END, 6) AS volume_z
    FROM bars WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def volume_z(spark, sf_dir):
    return rounded(ops.volume_z(t.bars(spark, sf_dir)).select("asset", "ts", "volume_z"))


@query("f4_signed_flow", f"{W} SELECT asset, ts, net FROM fn")
def signed_flow(spark, sf_dir):
    return flow(spark, sf_dir).select("asset", "ts", "net")


@query("f6_market_flow", f"""{W}, m AS (SELECT ts, sum(gross) AS gross, sum(net) AS net, {', '.join(f'sum(CASE WHEN cls = {k} THEN gross ELSE 0 END) / sum(gross) AS share_{k}' for k in range(4))} FROM fn GROUP BY 1)
    SELECT ts, round(gross, 0) AS gross, round(net, 0) AS net, {', '.join(f'round(share_{k}, 6) AS share_{k}' for k in range(4))}, round(sum(net) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING), 2) AS net_total FROM m""")
def market_flow(spark, sf_dir):
    return rounded(ops.market_flow(flow(spark, sf_dir)), gross=0, net=0, net_total=2)


@query("f7_flow_contributors", f"""{W}, n AS (SELECT *, date_diff('day', ts, (SELECT max(ts) FROM fn)) AS age FROM fn), s AS (SELECT asset, cls, sum(CASE WHEN age < 90 THEN gross ELSE 0 END) AS gross, sum(CASE WHEN age < 90 THEN net ELSE 0 END) AS net, sum(CASE WHEN age >= 90 THEN gross ELSE 0 END) AS b FROM n WHERE age < 180 GROUP BY 1, 2)
    SELECT asset, cls, round(gross, 2) AS gross, round(net, 2) AS net, round(gross / sum(gross) OVER (), 6) AS share, round(gross / sum(gross) OVER () - b / sum(b) OVER (), 6) AS share_change FROM s""")
def flow_contributors(spark, sf_dir):
    return rounded(ops.contributors(flow(spark, sf_dir), 90), gross=2, net=2)


ROT = """, al AS (SELECT ts, sum(gross) AS g FROM fn GROUP BY 1), rp AS (SELECT x.asset AS a, y.asset AS b, x.ts, x.gross / al.g AS sa, y.gross / al.g AS sb FROM fn x JOIN fn y ON x.ts = y.ts AND x.asset < y.asset JOIN al ON al.ts = x.ts),
    rd AS (SELECT a, b, sa - lag(sa) OVER w AS da, sb - lag(sb) OVER w AS db FROM rp WINDOW w AS (PARTITION BY a, b ORDER BY ts))"""


@query("f5_rotation_score", f"{W}{ROT} SELECT a, b, count(*) AS n, round(coalesce(corr(da, db), 0), 6) AS score FROM rd WHERE da IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10")
def rotation_score(spark, sf_dir):
    return rounded(ops.rotation_pairs(flow(spark, sf_dir), 10, 2.0))


#: Assets by market capitalisation whose pairs are looked at.
LARGEST = 60


@query("f8_rotation_pairs", f"{W}{ROT}, tp AS (SELECT asset FROM assets ORDER BY market_cap DESC, asset LIMIT {LARGEST}) SELECT a, b, count(*) AS n, round(coalesce(corr(da, db), 0), 6) AS score FROM rd WHERE da IS NOT NULL AND a IN (SELECT asset FROM tp) AND b IN (SELECT asset FROM tp) GROUP BY 1, 2 HAVING count(*) >= 30 AND coalesce(corr(da, db), 0) < -0.1")
def rotation_pairs(spark, sf_dir):
    largest = t.assets(spark, sf_dir).orderBy(F.desc("market_cap"), "asset").limit(LARGEST).select(F.col("asset").alias("_asset"))
    found = ops.rotation_pairs(flow(spark, sf_dir))
    for side in "ab":
        found = found.join(largest, F.col(side) == F.col("_asset"), "left_semi")
    return rounded(found)


@query("f9_class_rotation", f"{W} SELECT ts, cls, round(sum(gross) / sum(sum(gross)) OVER (PARTITION BY ts), 6) AS share FROM fn GROUP BY 1, 2")
def class_rotation(spark, sf_dir):
    own = flow(spark, sf_dir).groupBy("ts", "cls").agg(F.sum("gross").alias("gross"))
    return rounded(own.withColumn("share", F.col("gross") / F.sum("gross").over(Window.partitionBy("ts"))).drop("gross"))


@query("f10_flow_leaders", f"""{W}, n AS (SELECT *, date_diff('day', ts, (SELECT max(ts) FROM fn)) AS age FROM fn), s AS (SELECT asset, sum(CASE WHEN age < 30 THEN gross ELSE 0 END) AS r, sum(gross) AS b FROM n GROUP BY 1),
    h AS (SELECT asset, r / sum(r) OVER () AS recent, b / sum(b) OVER () AS base FROM s)
    SELECT asset, round(recent, 6) AS recent, round(base, 6) AS base, round(recent / base - 1, 6) AS shift, row_number() OVER (ORDER BY round(recent / base - 1, 9) DESC, asset) AS place FROM h""")
def flow_leaders(spark, sf_dir):
    own = flow(spark, sf_dir)
    now = own.agg(F.max("ts").alias("_now"))
    sums = own.join(F.broadcast(now)).groupBy("asset").agg(F.sum(F.when(F.datediff("_now", "ts") < 30, F.col("gross")).otherwise(0.0)).alias("_r"), F.sum("gross").alias("_b"))
    whole = Window.partitionBy()
    rows = sums.select("asset", (F.col("_r") / F.sum("_r").over(whole)).alias("recent"), (F.col("_b") / F.sum("_b").over(whole)).alias("base")).withColumn("shift", F.col("recent") / F.col("base") - 1)
    return rounded(rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round("shift", 9)), "asset"))))


STEPS = """, cal AS (SELECT ts, row_number() OVER (ORDER BY ts) AS k FROM (SELECT DISTINCT ts FROM bars)), fk AS (SELECT asset, cls, k, gross FROM fn JOIN cal USING (ts) WHERE gross > 0),
    p0 AS (SELECT x.asset, x.cls, x.k, x.gross AS before, y.gross AS now FROM fk x JOIN fk y ON y.asset = x.asset AND y.k = x.k + 1),
    p1 AS (SELECT *, count(*) OVER (PARTITION BY k) AS n, sum(before) OVER (PARTITION BY k) AS tb, sum(now) OVER (PARTITION BY k) AS tn FROM p0),
    st AS (SELECT *, now / tn - before / tb AS change FROM p1 WHERE n >= 2)"""
EDGES = """, gl AS (SELECT asset, k, tn, CASE WHEN change > 0.0002 THEN change ELSE 0 END AS gain, CASE WHEN change < -0.0002 THEN -change ELSE 0 END AS loss FROM st),
    g2 AS (SELECT *, sum(gain) OVER (PARTITION BY k) AS g, sum(loss) OVER (PARTITION BY k) AS l FROM gl),
    eg AS (SELECT x.asset AS from_asset, y.asset AS to_asset, sum(least(x.g, x.l) * x.tn * x.loss / x.l * y.gain / y.g) AS moved, count(*) AS steps FROM g2 x JOIN g2 y ON x.k = y.k WHERE x.g > 0 AND x.l > 0 AND x.loss > 0 AND y.gain > 0 GROUP BY 1, 2)"""


def calendar(spark, sf_dir):
    return t.bars(spark, sf_dir).select("ts").distinct().withColumn("k", F.row_number().over(Window.orderBy("ts")).cast("long"))


def steps(spark, sf_dir):
    return ops.participants(flow(spark, sf_dir), calendar(spark, sf_dir), 1)


@query("f11_flow_attribution", f"{W}{STEPS}{EDGES} SELECT from_asset, to_asset, round(moved, 2) AS moved, steps FROM eg")
def flow_attribution(spark, sf_dir):
    return rounded(ops.attribution(steps(spark, sf_dir)), 2)


@query("f11_size_changes", f"{W}{STEPS}, e AS (SELECT k, max(tn) - max(tb) AS d, max(n) AS p FROM st GROUP BY 1) SELECT round(sum(greatest(d, 0)), 2) AS inflow, round(sum(greatest(-d, 0)), 2) AS outflow, count(*) AS steps, round(avg(p), 6) AS mean_participants FROM e")
def size_changes(spark, sf_dir):
    return rounded(ops.size_changes(steps(spark, sf_dir)), inflow=2, outflow=2)


@query("f12_grouped_attribution", f"{W}{STEPS}{EDGES} SELECT x.cls AS from_group, y.cls AS to_group, round(sum(moved), 2) AS moved FROM eg JOIN assets x ON x.asset = from_asset JOIN assets y ON y.asset = to_asset WHERE x.cls <> y.cls GROUP BY 1, 2")
def grouped_attribution(spark, sf_dir):
    return rounded(ops.grouped_attribution(ops.attribution(steps(spark, sf_dir)), t.assets(spark, sf_dir), "cls"), 2)


ANOM = """, e AS (SELECT k, ln(max(tn) / max(tb)) AS change, sum(abs(change)) / 2 AS turnover FROM st GROUP BY 1),
    m AS (SELECT *, CASE WHEN count(*) OVER w = 60 THEN median(abs(change)) OVER w END AS mc, CASE WHEN count(*) OVER w = 60 THEN median(turnover) OVER w END AS mt FROM e WINDOW w AS (ORDER BY k ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
    z AS (SELECT *, abs(change) / (1.4826 * mc) AS z_change, greatest(0, turnover / mt - 1) AS z_turnover FROM m WHERE mc > 1e-9 AND mt > 1e-9),
    v AS (SELECT *, least(100, greatest(1, round_even(100 * (1 - exp(-z_change / 4)), 0))) AS sc, least(100, greatest(1, round_even(100 * (1 - exp(-2 * z_turnover / 4)), 0))) AS sv FROM z),
    an AS (SELECT k, CASE WHEN sv > sc THEN 'redistribution' WHEN change > 0 THEN 'inflow' ELSE 'outflow' END AS kind, z_change, z_turnover, greatest(sc, sv) AS severity FROM v WHERE greatest(sc, sv) >= 40)"""


@query("f13_flow_anomalies", f"{W}{STEPS}{ANOM} SELECT k, kind, round(z_change, 6) AS z_change, round(z_turnover, 6) AS z_turnover, CAST(severity AS DOUBLE) AS severity FROM an")
def flow_anomalies(spark, sf_dir):
    return rounded(ops.anomalies(steps(spark, sf_dir)))


@query("f14_coincidence", f"""{W}{STEPS}{ANOM}{RET}, ev AS (SELECT asset, k AS i FROM ret JOIN cal USING (ts) WHERE abs(r) > 2),
    m2 AS (SELECT ev.asset, ev.i, ev.i - an.k AS lag, row_number() OVER (PARTITION BY ev.asset, ev.i ORDER BY abs(ev.i - an.k), an.k) AS q FROM ev CROSS JOIN an)
    SELECT asset, count(*) AS events, count(*) FILTER (abs(lag) <= 3) AS hits, round(avg(lag) FILTER (abs(lag) <= 3), 6) AS mean_lag, round(avg(CASE WHEN lag < 0 THEN 1.0 ELSE 0 END) FILTER (abs(lag) <= 3), 6) AS lead_share,
           round((count(*) FILTER (abs(lag) <= 3) / count(*)) / least(1.0, (SELECT count(*) FROM an) * 7 / (SELECT count(*) FROM cal)), 6) AS lift FROM m2 WHERE q = 1 GROUP BY 1""")
def coincidence(spark, sf_dir):
    from tidewater.operators.bars import log_returns

    days = calendar(spark, sf_dir)
    found = ops.anomalies(steps(spark, sf_dir))
    events = log_returns(t.bars(spark, sf_dir)).where(F.abs("r") > 2).join(days, "ts").select("asset", F.col("k").alias("i"))
    matched = align.nearest_event(events, found.select(F.col("k").alias("i")), 3).where("nearest IS NOT NULL")
    sizes = found.agg(F.count(F.lit(1)).alias("_an")).join(F.broadcast(days.agg(F.count(F.lit(1)).alias("_days"))))
    return rounded(ops.coincidence(matched, sizes, 3))


OVER = """, ov0 AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts) AS i FROM bars), ov1 AS (SELECT *, volume * pow(2.0, i / 60) AS w FROM ov0),
    ov AS (SELECT asset, ts, i, close, CASE WHEN count(*) OVER q >= 20 THEN close / (sum(w * close) OVER q / sum(w) OVER q) - 1 END AS overhang FROM ov1 WINDOW q AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 480 PRECEDING AND 1 PRECEDING))"""
NEUTRAL = f"""{RET}, ne AS (SELECT asset, ts, CASE WHEN count(*) OVER (PARTITION BY ts) >= 3 THEN r - avg(r) OVER (PARTITION BY ts) END AS neutral FROM ret),
    ah AS (SELECT asset, ts, CASE WHEN count(neutral) OVER w = 10 THEN sum(neutral) OVER w END AS ahead FROM ne WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING))"""


@query("f15_overhang", f"WITH {D}{OVER} SELECT asset, ts, round(overhang, 6) AS overhang FROM ov")
def overhang(spark, sf_dir):
    return rounded(ops.overhang(t.bars(spark, sf_dir)).select("asset", "ts", "overhang"))


def studied(spark, sf_dir):
    """overhang, momentum and the market-neutral return of the next ten bars."""
    own = ops.forward_sum(ops.market_neutral(ops.overhang(t.bars(spark, sf_dir))), "neutral", 10)
    from tidewater.functions.series import own as w

    return own.withColumn("momentum", F.ln(F.col("close") / F.lag("close", 120).over(w())))


FIFTH = ", x5 AS (SELECT ahead, ntile(5) OVER (ORDER BY round(overhang, 9), asset, ts) AS fifth FROM ov JOIN ah USING (asset, ts) WHERE overhang IS NOT NULL AND ahead IS NOT NULL)"


@query("f16_overhang_quintiles", f"WITH {D}{OVER}{NEUTRAL}{FIFTH} SELECT fifth, round(avg(ahead), 6) AS mean_ahead, count(*) AS n, round(stddev_samp(ahead), 6) AS sd_ahead FROM x5 GROUP BY 1")
def overhang_quintiles(spark, sf_dir):
    return rounded(ops.quintile_study(studied(spark, sf_dir).withColumn("overhang", F.round("overhang", 9)), "overhang"))


@query("f16_overhang_spread", f"""WITH {D}{OVER}{NEUTRAL}{FIFTH}, q AS (SELECT fifth, avg(ahead) AS m, count(*) AS n, stddev_samp(ahead) AS s FROM x5 GROUP BY 1)
    SELECT round(h.m - l.m, 6) AS spread, round((h.m - l.m) / sqrt(h.s * h.s / h.n + l.s * l.s / l.n), 6) AS t FROM q h JOIN q l ON h.fifth = 5 AND l.fifth = 1""")
def overhang_spread(spark, sf_dir):
    return rounded(ops.spread_test(ops.quintile_study(studied(spark, sf_dir).withColumn("overhang", F.round("overhang", 9)), "overhang")))


MOM = ", mo AS (SELECT asset, ts, ln(close / lag(close, 120) OVER (PARTITION BY asset ORDER BY ts)) AS momentum FROM bars), cx AS (SELECT asset, ts, overhang, momentum, ahead FROM ov JOIN mo USING (asset, ts) JOIN ah USING (asset, ts) WHERE overhang IS NOT NULL AND momentum IS NOT NULL AND ahead IS NOT NULL)"


@query("f17_feature_control", f"""WITH {D}{OVER}{NEUTRAL}{MOM}, m AS (SELECT count(*) AS n, corr(overhang, ahead) AS r1, corr(momentum, ahead) AS r2, var_pop(overhang) AS xx, var_pop(momentum) AS zz, covar_pop(overhang, momentum) AS xz, covar_pop(overhang, ahead) AS xy, covar_pop(momentum, ahead) AS zy, var_pop(ahead) AS yy FROM cx),
    b AS (SELECT *, xx * zz - xz * xz AS det, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b1, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b2 FROM m), s AS (SELECT *, (yy - b1 * xy - b2 * zy) / (n - 3) AS s2 FROM b)
    SELECT n, round(r1, 6) AS r1, round(r2, 6) AS r2, round(xy / xx, 6) AS slope1, round(zy / zz, 6) AS slope2, round(b1, 6) AS joint1, round(b2, 6) AS joint2, round(b1 / sqrt(s2 * zz / det), 6) AS t1, round(b2 / sqrt(s2 * xx / det), 6) AS t2 FROM s""")
def feature_control(spark, sf_dir):
    return rounded(ops.feature_control(studied(spark, sf_dir), "overhang", "momentum"))


@query("f17_double_sort", f"""WITH {D}{OVER}{NEUTRAL}{MOM}, a AS (SELECT *, ntile(5) OVER (ORDER BY round(momentum, 9), asset, ts) AS fifth1 FROM cx), b AS (SELECT *, ntile(5) OVER (PARTITION BY fifth1 ORDER BY round(overhang, 9), asset, ts) AS fifth2 FROM a)
    SELECT fifth1, fifth2, round(avg(ahead), 6) AS mean_ahead, count(*) AS n FROM b GROUP BY 1, 2""")
def double_sort(spark, sf_dir):
    own = studied(spark, sf_dir).withColumn("overhang", F.round("overhang", 9)).withColumn("momentum", F.round("momentum", 9))
    return rounded(ops.double_sort(own, "momentum", "overhang"))


@query("f18_momentum", f"WITH {D} SELECT asset, ts, round(ln(close / lag(close, 120) OVER (PARTITION BY asset ORDER BY ts)), 6) AS momentum FROM bars")
def momentum(spark, sf_dir):
    from tidewater.functions.series import own as w

    return rounded(t.bars(spark, sf_dir).select("asset", "ts", F.ln(F.col("close") / F.lag("close", 120).over(w())).alias("momentum")))


@query("g10_market_neutral", f"WITH {D}{NEUTRAL} SELECT asset, ts, round(neutral, 6) AS neutral FROM ne")
def market_neutral(spark, sf_dir):
    return rounded(ops.market_neutral(t.bars(spark, sf_dir)).select("asset", "ts", "neutral"))


@query("f19_conserved_groups")
def conserved_groups(spark, sf_dir):
    weekly = ops.with_flow(t.bars(spark, sf_dir, "week"), t.assets(spark, sf_dir))
    return rounded(ops.conserved_groups(ops.shares(weekly).select("asset", "ts", "share"), datetime(1996, 6, 1)))
