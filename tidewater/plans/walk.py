"""Walk-forward evaluation, tracks and verdicts (K and A of the inventory): forecasts on weekly bars, verdicts on daily ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import align, bars as bar_ops, forecast as ops, leading, portfolio as books, verdicts as verdict_ops
from tidewater.sources import tables as t

from . import forecast as fc, portfolio as pf
from .registry import query, rounded

HISTORY = 60
CLIP = "least(0.5, greatest(-0.5, {p}))"
WALK = f"""WITH RECURSIVE {fc.WK}{fc.FC}, {fc.grown(HISTORY)}, cm AS (SELECT fc.asset, fc.h, fc.ts, fc.rn, target_ts, close, actual_close, w1 * {CLIP.format(p='naive')} + w2 * {CLIP.format(p='drift')} + w3 * {CLIP.format(p='momentum')} + w4 * {CLIP.format(p='meanrev')} AS combined
    FROM fc JOIN g ON g.asset = fc.asset AND g.h = fc.h AND g.i = greatest(0, fc.rn - fc.h - {HISTORY}) WHERE actual_close IS NOT NULL AND fc.rn > {HISTORY}){fc.SC}"""


def walked(spark, sf_dir):
    return ops.scored(ops.walk_forward(fc.made(spark, sf_dir), HISTORY))


@query("k26_walk_track", f"{WALK} SELECT asset, h, ts, target_ts, round(combined, 6) AS combined, round(abs_pct_error, 5) AS abs_pct_error, hit FROM sc")
def walk_track(spark, sf_dir):
    return rounded(walked(spark, sf_dir).select("asset", "h", "ts", "target_ts", "combined", "abs_pct_error", "hit"), abs_pct_error=5)


@query("k26_walk_forward", f"{WALK} SELECT h, CAST(floor(rn / 50) AS BIGINT) AS bucket, count(*) AS n, round(avg(abs_pct_error), 5) AS mean_error, round(avg(CASE WHEN hit THEN 1.0 ELSE 0 END), 6) AS hit_rate FROM sc GROUP BY 1, 2")
def walk_forward(spark, sf_dir):
    return rounded(ops.accuracy(walked(spark, sf_dir).withColumn("bucket", F.floor(F.col("rn") / 50)), ["h", "bucket"]), mean_error=5)


@query("k28_curve_listing", f"""{fc.B}, lo AS (UNPIVOT fc ON naive, drift, momentum, meanrev INTO NAME model VALUE predicted) SELECT h, model, CAST(floor(rn / 50) AS BIGINT) AS bucket, count(*) AS n, round(avg(100 * abs(close * exp({CLIP.format(p='predicted')}) - actual_close) / close), 5) AS mean_error
    FROM lo WHERE actual_close IS NOT NULL AND rn > {HISTORY} GROUP BY 1, 2, 3 ORDER BY bucket DESC, h, model LIMIT 100""")
def curve_listing(spark, sf_dir):
    rows = ops.long_form(fc.made(spark, sf_dir)).where((F.col("rn") > HISTORY) & F.col("actual_close").isNotNull())
    own_ = ops.scored(rows.withColumn("combined", F.least(F.lit(0.5), F.greatest(F.lit(-0.5), F.col("predicted"))))).groupBy("h", "model", F.floor(F.col("rn") / 50).alias("bucket"))
    return rounded(own_.agg(F.count(F.lit(1)).alias("n"), F.avg("abs_pct_error").alias("mean_error")).orderBy(F.desc("bucket"), "h", "model").limit(100), 5)


@query("a8_weight_upsert", f"SELECT asset, h, model, CASE WHEN h <= 5 THEN weight ELSE 0.25 END AS weight FROM ({fc.HEDGE})")
def weight_upsert(spark, sf_dir):
    made = fc.made(spark, sf_dir)
    old = made.select("asset", "h").distinct().select("asset", "h", F.explode(F.array(*map(F.lit, ops.MODELS))).alias("model"), F.lit(0.25).alias("weight"))
    return rounded(bar_ops.upsert(old, ops.learned_weights(made.where("h <= 5")), ["asset", "h", "model"]))


@query("a9_track_write", f"""{fc.B}{fc.CM}{fc.SC}, k AS (SELECT *, CAST(date_trunc('month', target_ts) AS TIMESTAMP) AS month FROM sc)
    SELECT asset, h, month, CASE WHEN month >= TIMESTAMP '1996-01-01' THEN max(ts) ELSE min(ts) END AS ts, CASE WHEN month >= TIMESTAMP '1996-01-01' THEN arg_max(round(combined, 6), ts) ELSE arg_min(round(combined, 6), ts) END AS combined FROM k GROUP BY 1, 2, 3""")
def track_write(spark, sf_dir):
    rows, keys = fc.scores(spark, sf_dir).select("asset", "h", F.date_trunc("month", "target_ts").alias("month"), "ts", "combined"), ["asset", "h", "month"]
    old = bar_ops.last_of_batch(rows, keys, [F.asc("ts")])
    return rounded(bar_ops.write_track(old, rows.where("month >= TIMESTAMP '1996-01-01'"), keys, [F.desc("ts")]))


#: Steps of the calendar between refreshes of the leaders, and how far these look back.
EVERY, BACK = 60, 500
REFRESH = f""", cal AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS t FROM (SELECT DISTINCT ts FROM bars)), bt AS (SELECT asset, t, close FROM bars JOIN cal USING (ts) WHERE close > 0),
    pq AS (SELECT x.asset AS a, y.asset AS b, x.t, ln(x.close) AS xa, ln(y.close) AS xb FROM bt x JOIN bt y ON x.t = y.t AND x.asset < y.asset),
    pd AS (SELECT a, b, t, lag(t) OVER w AS tp, xa - lag(xa) OVER w AS ra, xb - lag(xb) OVER w AS rb FROM pq WINDOW w AS (PARTITION BY a, b ORDER BY t)), ee AS (SELECT unnest(range({HISTORY}, (SELECT max(t) FROM cal) + 1, {EVERY})) AS e),
    wn AS (SELECT a, b, e, t, CASE WHEN tp >= e - {BACK} THEN ra END AS ra, CASE WHEN tp >= e - {BACK} THEN rb END AS rb FROM pd JOIN ee ON t BETWEEN e - {BACK} AND e),
    w0 AS (SELECT a, b, e, coalesce(corr(ra, rb), 0) AS corr0, count(*) AS n FROM wn GROUP BY 1, 2, 3 HAVING count(*) >= 60),
    wi AS (SELECT wn.*, row_number() OVER (PARTITION BY a, b, e ORDER BY t) AS i FROM wn JOIN w0 USING (a, b, e) WHERE ra IS NOT NULL AND abs(round(corr0, 9)) >= 0.15),
    wl AS (SELECT x.a, x.b, x.e, g.lag, coalesce(CASE WHEN count(*) < 3 THEN 0 ELSE corr(x.ra, y.rb) END, 0) AS r FROM wi x CROSS JOIN (SELECT unnest(range(-12, 13)) AS lag) g JOIN wi y ON y.a = x.a AND y.b = x.b AND y.e = x.e AND y.i = x.i + g.lag GROUP BY 1, 2, 3, 4),
    wb AS (SELECT * FROM wl QUALIFY row_number() OVER (PARTITION BY a, b, e ORDER BY round(abs(r), 9) DESC, lag) = 1),
    rf AS (SELECT CAST(w0.e AS INT) AS refresh, w0.a, w0.b, CAST(w0.n AS INT) AS n, corr0, CAST(coalesce(wb.lag, 0) AS INT) AS lag, coalesce(wb.r, corr0) AS lag_corr FROM w0 LEFT JOIN wb ON wb.a = w0.a AND wb.b = w0.b AND wb.e = w0.e)"""
SIGNAL = REFRESH + """, l0 AS (SELECT refresh, CASE WHEN lag > 0 THEN b ELSE a END AS asset, CASE WHEN lag > 0 THEN a ELSE b END AS leader, abs(lag) AS lag, round(lag_corr, 6) AS lag_corr FROM rf WHERE lag <> 0 QUALIFY row_number() OVER (PARTITION BY refresh, asset ORDER BY abs(round(lag_corr, 6)) DESC, leader) <= 5),
    bi AS (SELECT asset, t, ln(close) AS x, row_number() OVER (PARTITION BY asset ORDER BY t) AS i FROM bt),
    lu AS (SELECT l0.*, (SELECT max(i) FROM bi WHERE bi.asset = l0.leader AND bi.t <= l0.refresh) AS i FROM l0),
    ls AS (SELECT refresh, lu.asset, leader, lag, lag_corr, p.x - q.x AS recent FROM lu JOIN bi p ON p.asset = leader AND p.i = lu.i JOIN bi q ON q.asset = leader AND q.i = greatest(1, lu.i - lag))"""


def refreshes(spark, sf_dir, unit="day"):
    return leading.pair_refreshes(t.bars(spark, sf_dir, unit), HISTORY, EVERY, BACK)


@query("k26_pair_refreshes", f"WITH {t.DAILY_SQL}{REFRESH} SELECT refresh, a, b, n, round(corr0, 6) AS corr0, lag, round(lag_corr, 6) AS lag_corr FROM rf")
def pair_refreshes(spark, sf_dir):
    return rounded(refreshes(spark, sf_dir))


@query("k26_lead_signals", f"WITH {t.DAILY_SQL}{SIGNAL} SELECT refresh, asset, leader, lag, lag_corr, round(recent, 6) AS recent FROM ls")
def lead_signals(spark, sf_dir):
    return rounded(leading.lead_signals(refreshes(spark, sf_dir), t.bars(spark, sf_dir)))


def five(bars, hours: dict[int, int], number: int, least: float = 0.3):
    """The forecasts of all five models in one pass; hours: those of each horizon in bars."""
    made = ops.forecasts(bars, tuple(hours))
    known = leading.lead_predictions(leading.lead_signals(leading.pair_refreshes(bars, HISTORY, EVERY, BACK), bars), tuple(hours), least)
    rows = leading.with_leaders(made, known, leading.calendar(bars), HISTORY, EVERY)
    return rows.withColumn("pass", F.lit(number)).withColumn("hours", F.element_at(F.create_map(*[F.lit(x) for pair in hours.items() for x in pair]), F.col("h")))


L5 = f"""{SIGNAL}, hz AS (SELECT unnest([1, 5, 20]) AS h), lp AS (SELECT refresh, asset, h, sum(abs(lag_corr) * recent) / sum(abs(lag_corr)) AS leadlag FROM ls, hz WHERE abs(lag_corr) >= 0.15 AND lag >= h GROUP BY 1, 2, 3),
    f5 AS (SELECT fc.*, coalesce(leadlag, 0) AS leadlag FROM fc JOIN cal ON cal.ts = fc.ts LEFT JOIN lp ON lp.asset = fc.asset AND lp.h = fc.h AND lp.refresh = CASE WHEN cal.t >= {HISTORY} THEN cal.t - (cal.t - {HISTORY}) % {EVERY} END)"""
NAMES = ("naive", "drift", "momentum", "meanrev", "leadlag")


def five_grown() -> str:
    """SQL of five models' weights after i arrived forecasts."""
    each = range(1, 6)
    shrunk = ", ".join(f"w{k} * exp(-0.5 * ({fc.LOSS.format(p=m)})) AS x{k}" for k, m in zip(each, NAMES, strict=True))
    total = lambda c: " + ".join(f"{c}{k}" for k in each)
    return f"""o5 AS MATERIALIZED (SELECT asset, h, row_number() OVER (PARTITION BY asset, h ORDER BY target_ts) AS i, ln(actual_close / close) AS a, {", ".join(NAMES)} FROM f5 WHERE actual_close IS NOT NULL AND rn > {HISTORY}),
    g5 AS (SELECT asset, h, 0::BIGINT AS i, {", ".join(f"0.2::DOUBLE AS w{k}" for k in each)} FROM (SELECT DISTINCT asset, h FROM o5) UNION ALL
      SELECT asset, h, i, {", ".join(f"l{k} / ({total('l')})" for k in each)} FROM (SELECT asset, h, i, {", ".join(f"greatest(0.01, x{k} / ({total('x')})) AS l{k}" for k in each)} FROM (SELECT o5.asset, o5.h, o5.i, {shrunk} FROM g5 JOIN o5 ON o5.asset = g5.asset AND o5.h = g5.h AND o5.i = g5.i + 1)))"""


LEADER_WALK = f"""WITH RECURSIVE {fc.WK}{fc.FC}{L5}, {five_grown()}, cm AS (SELECT f5.asset, f5.h, f5.ts, f5.rn, target_ts, close, actual_close, leadlag, {" + ".join(f"w{k} * {CLIP.format(p=m)}" for k, m in enumerate(NAMES, 1))} AS combined
    FROM f5 JOIN g5 ON g5.asset = f5.asset AND g5.h = f5.h AND g5.i = greatest(0, f5.rn - f5.h - {HISTORY}) WHERE actual_close IS NOT NULL AND f5.rn > {HISTORY}){fc.SC}"""


@query("k26_leader_walk", f"{LEADER_WALK} SELECT asset, h, ts, target_ts, round(combined, 6) AS combined, round(abs_pct_error, 5) AS abs_pct_error, hit FROM sc")
def leader_walk(spark, sf_dir):
    """One pass of all five models over weekly bars. Leaders count from a correlation of 0.15, as the test prices carry no structure."""
    made = five(t.bars(spark, sf_dir, "week"), {1: 1, 5: 5, 20: 20}, 1, 0.15)
    return rounded(ops.scored(leading.walk_passes(made)).select("asset", "h", "ts", "target_ts", "combined", "abs_pct_error", "hit"), abs_pct_error=5)


def three_passes(spark, sf_dir):
    """Days, hours, days again; horizons in hours. What a pass learns for an asset and horizon the next one goes on with."""
    days, day = t.bars(spark, sf_dir), {1: 24, 5: 120, 20: 480}
    once = five(days, day, 1)
    hours = five(t.hourly_bars(spark, sf_dir), {1: 1, 4: 4, 24: 24}, 2)
    return leading.walk_passes(once.unionByName(hours).unionByName(once.withColumn("pass", F.lit(3))))


@query("k26_three_passes")
def pass_results(spark, sf_dir):
    return rounded(leading.pass_summary(ops.scored(three_passes(spark, sf_dir))))


@query("k28_epoch_listing")
def epoch_listing(spark, sf_dir):
    """The passes of a run, newest first: what they walked over and how well."""
    scores = ops.scored(three_passes(spark, sf_dir))
    rows = scores.groupBy("pass").agg(F.array_sort(F.collect_set("hours")).alias("horizons"), F.count_distinct("asset").alias("assets"), F.count_distinct("ts").alias("steps"), F.count(F.lit(1)).alias("scored"), F.avg("abs_pct_error").alias("mean_error"), F.avg(F.col("hit").cast("double")).alias("hit_rate"))
    interval = F.when(F.col("pass") == 2, "1h").otherwise("1d")
    return rounded(rows.select(F.lit("walk").alias("run"), "pass", interval.alias("interval"), "horizons", "assets", "steps", "scored", "mean_error", "hit_rate").orderBy(F.desc("pass")))


@query("k26_learned_weights")
def learned_weights(spark, sf_dir):
    return rounded(leading.learned(three_passes(spark, sf_dir)))


VERDICT = f"""{t.DAILY_SQL}, vd AS (SELECT o_orderkey AS verdict_id, 'Brand#' || (o_custkey % 5 + 1) || ((o_orderkey // 5) % 5 + 1) AS asset, CAST(o_orderdate AS TIMESTAMP) AS asked, CAST(o_orderkey % 5 - 2 AS INT) AS direction, ((o_custkey // 5) % 11) / 10 AS confidence FROM orders),
    bn AS (SELECT asset, ts, close, lead(close, 5) OVER (PARTITION BY asset ORDER BY ts) AS later FROM bars WHERE close > 0),
    vs AS (SELECT verdict_id, vd.asset, asked, direction, confidence, ln(later / close) AS realised, CASE WHEN direction <> 0 THEN sign(ln(later / close)) = sign(direction) END AS hit FROM vd ASOF JOIN bn ON bn.asset = vd.asset AND bn.ts <= vd.asked WHERE later IS NOT NULL)"""


def verdicts(spark, sf_dir):
    """Orders stand for verdicts on the brands."""
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    asset = F.concat(F.lit("Brand#"), who % 5 + 1, F.floor(key / 5) % 5 + 1)
    return t.table(spark, sf_dir, "orders").select(key.alias("verdict_id"), asset.alias("asset"), F.col("o_orderdate").cast("timestamp").alias("asked"), (key % 5 - 2).cast("int").alias("direction"), (F.floor(who / 5) % 11 / 10).alias("confidence"))


@query("k32_verdict_scoring", f"WITH {VERDICT} SELECT verdict_id, asset, direction, round(realised, 6) AS realised, CAST(hit AS INT) AS hit FROM vs")
def verdict_scoring(spark, sf_dir):
    return rounded(verdict_ops.scored(verdicts(spark, sf_dir), t.bars(spark, sf_dir)).select("verdict_id", "asset", "direction", "realised", F.col("hit").cast("int").alias("hit")))


@query("k31_verdict_contribution", f"""WITH {VERDICT}, nw AS (SELECT max(asked) AS now FROM vd), m AS (SELECT CASE WHEN count(*) < 20 THEN 0.25 ELSE least(1, greatest(0, (avg(CASE WHEN hit THEN 1.0 ELSE 0 END) - 0.5) / 0.2)) END AS merit FROM vs WHERE direction <> 0),
    nv AS (SELECT asset, direction, confidence FROM vd, nw WHERE asked >= now - INTERVAL 3 DAY QUALIFY row_number() OVER (PARTITION BY asset ORDER BY asked DESC, verdict_id DESC) = 1),
    sg AS (SELECT asset, stddev_samp(r) AS s FROM (SELECT asset, ln(close / lag(close) OVER (PARTITION BY asset ORDER BY ts)) AS r FROM bn, nw WHERE ts >= now - INTERVAL 180 DAY) GROUP BY 1)
    SELECT nv.asset, h, round(direction / 2 * confidence * s * sqrt(h), 6) AS value, round(merit, 6) AS merit FROM nv JOIN sg USING (asset) CROSS JOIN m CROSS JOIN (SELECT unnest([1, 5, 20]) AS h) WHERE direction <> 0 AND s > 0""")
def verdict_contribution(spark, sf_dir):
    given, bars = verdicts(spark, sf_dir), t.bars(spark, sf_dir)
    return rounded(verdict_ops.contributions(given, bars, verdict_ops.merit(verdict_ops.scored(given, bars)), (1, 5, 20)))


#: Depots in other currencies and the series that stands for their rate, and the depot that doesn't count.
RATES, LEFT_OUT = {"2-HIGH": "Brand#11", "3-MEDIUM": "Brand#12"}, "5-LOW"


@query("m16_total_in_currency", f"""{pf.WEALTH}, fg AS (SELECT a.asset, c.ts, last_value(close IGNORE NULLS) OVER (PARTITION BY a.asset ORDER BY c.ts ROWS UNBOUNDED PRECEDING) / 1000 AS rate FROM (SELECT DISTINCT asset FROM bars) a CROSS JOIN cal c LEFT JOIN bars b ON b.asset = a.asset AND b.ts = c.ts),
    pd AS (SELECT st.depot, st.ts, (SELECT coalesce(CAST(sum(amount) AS DOUBLE), 0) FROM mv WHERE mv.depot = st.depot AND mv.booked <= st.ts AND reason IN ('deposit', 'withdrawal')) AS paid FROM st),
    tt AS (SELECT we.ts, (positions + cash) * rt AS total, paid * rt AS paid FROM (SELECT we.*, CASE depot WHEN '2-HIGH' THEN 'Brand#11' WHEN '3-MEDIUM' THEN 'Brand#12' END AS fx FROM we WHERE depot <> '{LEFT_OUT}') we JOIN pd USING (depot, ts) LEFT JOIN fg ON fg.asset = fx AND fg.ts = we.ts CROSS JOIN LATERAL (SELECT CASE WHEN fx IS NULL THEN 1.0 ELSE rate END AS rt))
    SELECT ts, round(sum(total), 0) AS total, round(sum(total) - sum(paid), 0) AS gain FROM tt GROUP BY 1""")
def total_in_currency(spark, sf_dir):
    week = t.bars(spark, sf_dir, "week")
    moves = pf.moves(spark, sf_dir)
    wealth = books.wealth_curve(pf.bookings(spark, sf_dir), moves, week)
    paid = books.wealth_curve(pf.bookings(spark, sf_dir), moves.where("reason IN ('deposit', 'withdrawal')"), week).select("depot", "ts", F.col("cash").alias("paid"))
    rates = align.forward_fill(align.densify(week)).select(F.col("asset").alias("series"), "ts", (F.col("filled") / 1000).alias("rate"))
    return rounded(books.total(wealth.join(paid, ["depot", "ts"]).where(F.col("depot") != LEFT_OUT), rates, RATES), 0)
