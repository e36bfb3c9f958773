"""Forecasting, mixing and scoring (K of the inventory), on weekly bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.functions.series import own, slope, upper_median
from tidewater.operators import forecast as ops
from tidewater.operators import pairs as pair_ops
from tidewater.sources import tables as t

from . import pairs as p
from .alignment import WK
from .registry import query, rounded

H = (1, 5, 20)
WIN = "PARTITION BY asset ORDER BY ts"
FC = f""", q0 AS (SELECT asset, ts, close, row_number() OVER ({WIN}) AS rn, ln(close / lag(close) OVER ({WIN})) AS r FROM bars WHERE close > 0),
    q1 AS (SELECT *, CASE WHEN count(r) OVER ({WIN} ROWS 199 PRECEDING) >= 5 THEN avg(r) OVER ({WIN} ROWS 199 PRECEDING) ELSE 0 END AS dr, list(r) FILTER (r IS NOT NULL) OVER ({WIN} ROWS 119 PRECEDING) AS lr,
      count(*) OVER ({WIN} ROWS 49 PRECEDING) AS n50, stddev_samp(ln(close)) OVER ({WIN} ROWS 49 PRECEDING) AS s50, ln(close) - avg(ln(close)) OVER ({WIN} ROWS 49 PRECEDING) AS off FROM q0),
    q2 AS (SELECT *, CASE WHEN len(lr) >= 5 THEN list_reduce(lr, lambda acc, x: 0.2 * x + 0.8 * acc) ELSE 0 END AS tr, CASE WHEN n50 >= 10 AND s50 > 0 THEN off ELSE 0 END AS of FROM q1),
    fc AS (""" + " UNION ALL ".join(f"SELECT asset, ts, rn, {h} AS h, close, 0.0::DOUBLE AS naive, dr * {h} AS drift, tr * (1 - pow(0.5, {h})) / 0.5 AS momentum, -of * least(1.0, 0.15 * sqrt({h})) AS meanrev, lead(ts, {h}) OVER ({WIN}) AS target_ts, lead(close, {h}) OVER ({WIN}) AS actual_close FROM q2" for h in H) + ")"
CM = """, lo AS (UNPIVOT fc ON naive, drift, momentum, meanrev INTO NAME model VALUE predicted),
    cm AS (SELECT asset, ts, rn, h, close, target_ts, actual_close, avg(least(0.5, greatest(-0.5, predicted))) AS combined, coalesce(stddev_samp(least(0.5, greatest(-0.5, predicted))), 0) AS spread FROM lo GROUP BY ALL)"""
SC = """, sc AS (SELECT *, ln(actual_close / close) AS actual_return, 100 * abs(close * exp(combined) - actual_close) / close AS abs_pct_error,
    CASE WHEN abs(ln(actual_close / close)) < 1e-6 THEN abs(combined) < 1e-3 ELSE sign(combined) = sign(ln(actual_close / close)) END AS hit FROM cm WHERE actual_close IS NOT NULL)"""
B = f"WITH {WK}{FC}"


def made(spark, sf_dir):
    return ops.forecasts(t.bars(spark, sf_dir, "week"), H)


def scores(spark, sf_dir):
    return ops.scored(ops.combine(made(spark, sf_dir)))


def of_model(name, model):
    @query(name, f"{B} SELECT asset, ts, h, round({model}, 6) AS predicted FROM fc")
    def run(spark, sf_dir):
        return rounded(made(spark, sf_dir).select("asset", "ts", "h", F.col(model).alias("predicted")))


for _name, _model in (("k1_naive", "naive"), ("k2_drift", "drift"), ("k3_momentum", "momentum"), ("k4_mean_reversion", "meanrev")):
    of_model(_name, _model)


LEADLAG = f"""{p.W_STATS}{p.LEAD}, le AS (SELECT * FROM ld WHERE place <= 5 AND abs(lag_corr) >= 0.05), rr AS (SELECT asset, ts, ln(close / lag(close) OVER (PARTITION BY asset ORDER BY ts)) AS r FROM bars),
    mt AS (SELECT le.asset, le.leader, lag, lag_corr, x.ts, x.r AS rl, y.r AS r FROM le JOIN rr x ON x.asset = le.leader JOIN rr y ON y.asset = le.asset AND y.ts = x.ts),
    sh AS (SELECT *, lag(rl, CAST(lag AS INT)) OVER w AS past, row_number() OVER w AS i, count(*) OVER (PARTITION BY asset, leader) AS n FROM mt WINDOW w AS (PARTITION BY asset, leader ORDER BY ts)),
    sg AS (SELECT asset, leader, lag_corr, CASE WHEN count(past) < 3 THEN 0 ELSE coalesce(regr_slope(r, past), 0) END AS beta, sum(CASE WHEN i < n AND i >= n - lag THEN rl END) AS recent FROM sh GROUP BY asset, leader, lag_corr, lag)"""


@query("k5_lead_lag", f"{LEADLAG} SELECT asset, round(sum(abs(lag_corr) * beta * recent) / sum(abs(lag_corr)), 6) AS predicted, count(*) AS leaders FROM sg GROUP BY 1")
def lead_lag(spark, sf_dir):
    """Leaders' last returns over their lag, times beta, weighed by |r|; K6 builds the signals."""
    led = pair_ops.leaders(p.stats(spark, sf_dir), 5).where(F.abs("lag_corr") >= 0.05)
    bars = t.bars(spark, sf_dir, "week").withColumn("rn", F.row_number().over(own())).withColumn("r", F.ln(F.col("close") / F.lag("close").over(own())))
    x, y = bars.select(F.col("asset").alias("leader"), "ts", "rn", F.col("r").alias("rl"), F.col("close").alias("cl")), bars.select("asset", "ts", "r")
    w = Window.partitionBy("asset", "leader").orderBy("ts")
    met = led.join(x, "leader").join(y, ["asset", "ts"])
    shifted = met.withColumn("_past", F.collect_list("rl").over(w.rowsBetween(-12, -1)))
    shifted = shifted.withColumn("rl_lag", F.try_element_at("_past", -F.col("lag")))
    signal = shifted.groupBy("asset", "leader", "lag", "lag_corr").agg(slope("r", "rl_lag").alias("beta"), F.max_by(F.aggregate(F.slice(F.reverse("_past"), 1, F.col("lag")), F.lit(0.0), lambda a, v: a + v), "ts").alias("recent"))
    out = signal.groupBy("asset").agg(F.try_divide(F.sum(F.abs("lag_corr") * F.col("beta") * F.col("recent")), F.sum(F.abs("lag_corr"))).alias("predicted"), F.count(F.lit(1)).alias("leaders"))
    return rounded(out)


@query("k7_ensemble", f"{B}{CM} SELECT asset, ts, h, round(combined, 6) AS combined, round(spread, 6) AS spread FROM cm")
def ensemble(spark, sf_dir):
    return rounded(ops.combine(made(spark, sf_dir)).select("asset", "ts", "h", "combined", "spread"))


LOSS = "least(4.0, abs({p} - a) / greatest(0.002, 2 * abs(a))) + CASE WHEN abs(a) > 1e-5 AND (abs({p}) < 1e-4 OR sign({p}) <> sign(a)) THEN 1.2 ELSE 0 END"
def grown(after: int = 0) -> str:
    """SQL of the weights after i arrived forecasts of those made after so many bars."""
    return f"""o AS (SELECT asset, h, row_number() OVER (PARTITION BY asset, h ORDER BY target_ts) AS i, ln(actual_close / close) AS a, naive, drift, momentum, meanrev FROM fc WHERE actual_close IS NOT NULL AND rn > {after}),
    g AS (SELECT asset, h, 0::BIGINT AS i, 0.25::DOUBLE AS w1, 0.25::DOUBLE AS w2, 0.25::DOUBLE AS w3, 0.25::DOUBLE AS w4 FROM (SELECT DISTINCT asset, h FROM o)
      UNION ALL
      SELECT asset, h, i, l1 / (l1 + l2 + l3 + l4), l2 / (l1 + l2 + l3 + l4), l3 / (l1 + l2 + l3 + l4), l4 / (l1 + l2 + l3 + l4) FROM (
        SELECT asset, h, i, greatest(0.01, x1 / (x1 + x2 + x3 + x4)) AS l1, greatest(0.01, x2 / (x1 + x2 + x3 + x4)) AS l2, greatest(0.01, x3 / (x1 + x2 + x3 + x4)) AS l3, greatest(0.01, x4 / (x1 + x2 + x3 + x4)) AS l4 FROM (
          SELECT o.asset, o.h, o.i, w1 * exp(-0.5 * ({LOSS.format(p='naive')})) AS x1, w2 * exp(-0.5 * ({LOSS.format(p='drift')})) AS x2, w3 * exp(-0.5 * ({LOSS.format(p='momentum')})) AS x3, w4 * exp(-0.5 * ({LOSS.format(p='meanrev')})) AS x4
          FROM g JOIN o ON o.asset = g.asset AND o.h = g.h AND o.i = g.i + 1)))"""


HEDGE = f"""WITH RECURSIVE {WK}{FC}, {grown()},
    e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset, h ORDER BY i DESC) AS q FROM g) WHERE q = 1)
    SELECT asset, h, 'naive' AS model, round(w1, 6) AS weight FROM e UNION ALL SELECT asset, h, 'drift', round(w2, 6) FROM e UNION ALL SELECT asset, h, 'momentum', round(w3, 6) FROM e UNION ALL SELECT asset, h, 'meanrev', round(w4, 6) FROM e"""


@query("k8_hedge_weights", HEDGE)
def hedge_weights(spark, sf_dir):
    return rounded(ops.learned_weights(made(spark, sf_dir)))


@query("k9_forecast_run", f"{B}{CM}, l AS (SELECT *, row_number() OVER (PARTITION BY asset, h ORDER BY ts DESC) AS q FROM cm) SELECT asset, h, ts, close, round(combined, 6) AS combined, round(close * exp(combined), 3) AS predicted_close FROM l WHERE q = 1")
def forecast_run(spark, sf_dir):
    latest = Window.partitionBy("asset", "h").orderBy(F.desc("ts"))
    own_ = made(spark, sf_dir).withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")
    return ops.combine(own_).select("asset", "h", "ts", "close", F.round("combined", 6).alias("combined"), F.round(F.col("close") * F.exp("combined"), 3).alias("predicted_close"))


HITS = """lo AS (UNPIVOT fc ON naive, drift, momentum, meanrev INTO NAME model VALUE predicted),
    hr AS (SELECT asset, h, model, avg(CASE WHEN abs(ln(actual_close / close)) < 1e-6 THEN CASE WHEN abs(predicted) < 1e-3 THEN 1.0 ELSE 0 END WHEN sign(predicted) = sign(ln(actual_close / close)) THEN 1.0 ELSE 0 END) AS hit_rate FROM lo WHERE actual_close IS NOT NULL GROUP BY 1, 2, 3)"""


@query("k9_run_components", f"""WITH RECURSIVE {WK}{FC}, {grown()}, {HITS}, e AS (UNPIVOT (SELECT asset, h, w1 AS naive, w2 AS drift, w3 AS momentum, w4 AS meanrev FROM g QUALIFY row_number() OVER (PARTITION BY asset, h ORDER BY i DESC) = 1) ON naive, drift, momentum, meanrev INTO NAME model VALUE weight),
    n AS (SELECT lo.*, least(0.5, greatest(-0.5, predicted)) AS p, weight AS w, hit_rate FROM (SELECT * FROM lo QUALIFY row_number() OVER (PARTITION BY asset, h, model ORDER BY ts DESC) = 1) lo LEFT JOIN e USING (asset, h, model) LEFT JOIN hr USING (asset, h, model)),
    c AS (SELECT asset, h, ts, close, target_ts, sum(w * p) / sum(w) AS combined, stddev_samp(p) AS spread, sum(w * hit_rate) / sum(w) AS q, {", ".join(f"max(CASE WHEN model = '{m}' THEN p END) AS {m}" for m in ops.MODELS)} FROM n GROUP BY 1, 2, 3, 4, 5)
    SELECT asset, h, ts, round(close, 6) AS close, target_ts, round(combined, 6) AS combined, round(spread, 6) AS spread, {", ".join(f"round({m}, 6) AS {m}" for m in ops.MODELS)}, round(least(1, greatest(0, q / (1 + 20 * spread))), 6) AS confidence FROM c""")
def run_components(spark, sf_dir):
    """The newest forecast of every asset and horizon by learned weights, with its confidence and components."""
    all_ = made(spark, sf_dir)
    newest = all_.withColumn("_n", F.row_number().over(Window.partitionBy("asset", "h").orderBy(F.desc("ts")))).where("_n = 1").drop("_n")
    return rounded(ops.ensemble(newest, ops.learned_weights(all_), ops.model_hits(all_)))


PIL = """, me AS (SELECT asset, h, avg(CASE WHEN hit THEN 1.0 ELSE 0 END) AS hr, count(*) AS n FROM sc GROUP BY 1, 2), la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset, h ORDER BY ts DESC) AS q FROM fc) WHERE q = 1),
    pi AS (SELECT la.asset, la.h, p.pillar, CASE p.pillar WHEN 'learning' THEN (drift + momentum) / 2 WHEN 'reversion' THEN meanrev ELSE momentum END AS value,
      CASE WHEN n >= 20 THEN least(1, greatest(0, (hr - 0.523) / 0.10)) ELSE 0.25 END AS merit, p.slider, p.surcharge FROM la JOIN me USING (asset, h) CROSS JOIN (VALUES ('learning', 100.0, false), ('reversion', 50.0, false), ('news', 40.0, true)) p(pillar, slider, surcharge)),
    mx AS (SELECT asset, h, coalesce(sum(CASE WHEN NOT surcharge THEN value * merit * slider END) / nullif(sum(CASE WHEN NOT surcharge THEN merit * slider END), 0), 0) AS basis, sum(CASE WHEN surcharge THEN value * merit * slider / 100 ELSE 0 END) AS x, count(*) AS pillars FROM pi GROUP BY 1, 2)"""


def mixed(spark, sf_dir):
    merit = scores(spark, sf_dir).groupBy("asset", "h").agg(F.avg(F.col("hit").cast("double")).alias("hr"), F.count(F.lit(1)).alias("n"))
    latest = made(spark, sf_dir).withColumn("_n", F.row_number().over(Window.partitionBy("asset", "h").orderBy(F.desc("ts")))).where("_n = 1").join(merit, ["asset", "h"])
    pillars = [("learning", (F.col("drift") + F.col("momentum")) / 2, 100.0, False), ("reversion", F.col("meanrev"), 50.0, False), ("news", F.col("momentum"), 40.0, True)]
    each = F.array(*[F.struct(F.lit(k).alias("pillar"), v.alias("value"), F.lit(s).alias("slider"), F.lit(x).alias("surcharge")) for k, v, s, x in pillars])
    rows = latest.withColumn("_p", F.explode(each)).select("asset", "h", "_p.*", ops.own_merit(F.col("hr"), F.col("n")).alias("merit"))
    return ops.mix_pillars(rows)


@query("k10_pillar_mixing", f"{B}{CM}{SC}{PIL} SELECT asset, h, round(basis, 6) AS basis, round(greatest(-greatest(0.01, abs(basis)), least(greatest(0.01, abs(basis)), x)), 6) AS extra, round(basis + greatest(-greatest(0.01, abs(basis)), least(greatest(0.01, abs(basis)), x)), 6) AS mixed, pillars FROM mx")
def pillar_mixing(spark, sf_dir):
    return rounded(mixed(spark, sf_dir).drop("trace"))


@query("k10_pillar_trace", f"""{B}{CM}{SC}{PIL}, xt AS (SELECT mx.*, greatest(-greatest(0.01, abs(basis)), least(greatest(0.01, abs(basis)), x)) AS extra, (SELECT sum(merit * slider) FROM pi WHERE pi.asset = mx.asset AND pi.h = mx.h AND NOT surcharge) AS w FROM mx)
    SELECT pi.asset, pi.h, pillar, round(value, 6) AS value, round(merit, 6) AS merit, round(coalesce(CASE WHEN surcharge THEN value * merit * slider / 100 * extra / nullif(x, 0) ELSE value * merit * slider / nullif(w, 0) END, 0), 6) AS adds FROM pi JOIN xt ON xt.asset = pi.asset AND xt.h = pi.h""")
def pillar_trace(spark, sf_dir):
    return rounded(mixed(spark, sf_dir).select("asset", "h", F.explode("trace").alias("_t")).select("asset", "h", "_t.*"))


@query("k12_due_forecasts", f"""{B}{CM} SELECT asset, ts, h, target_ts FROM cm WHERE target_ts IS NOT NULL AND h = 5 AND target_ts > (SELECT max(ts) FROM bars) - INTERVAL 90 DAY ORDER BY target_ts, asset, ts LIMIT 500""")
def due_forecasts(spark, sf_dir):
    own_ = ops.combine(made(spark, sf_dir))
    now = t.bars(spark, sf_dir, "week").agg(F.max("ts").alias("_now"))
    due = own_.where("target_ts IS NOT NULL AND h = 5").join(F.broadcast(now)).where(F.col("target_ts") > F.col("_now") - F.expr("INTERVAL 90 DAYS"))
    return due.orderBy("target_ts", "asset", "ts").limit(500).select("asset", "ts", "h", "target_ts")


@query("k13_unscoreable", f"""WITH {t.DAILY_SQL}, o AS (SELECT asset, ts, ts + INTERVAL 2 DAY AS target FROM bars), m AS (SELECT max(ts) AS now FROM bars)
    SELECT asset, ts FROM o, m WHERE target < now AND NOT EXISTS (SELECT 1 FROM bars b WHERE b.asset = o.asset AND b.ts > o.ts AND b.ts <= o.target)""")
def unscoreable(spark, sf_dir):
    bars = t.bars(spark, sf_dir)
    now = bars.agg(F.max("ts").alias("_now"))
    rows = bars.select("asset", "ts", F.lead("ts").over(own()).alias("_next")).join(F.broadcast(now)).withColumn("_target", F.col("ts") + F.expr("INTERVAL 2 DAYS"))
    return rows.where((F.col("_target") < F.col("_now")) & (F.col("_next").isNull() | (F.col("_next") > F.col("_target")))).select("asset", "ts")


@query("k14_scoring", f"{B}{CM}{SC} SELECT asset, ts, h, round(actual_return, 6) AS actual_return, round(abs_pct_error, 5) AS abs_pct_error, hit FROM sc")
def scoring(spark, sf_dir):
    return scores(spark, sf_dir).select("asset", "ts", "h", F.round("actual_return", 6).alias("actual_return"), F.round("abs_pct_error", 5).alias("abs_pct_error"), "hit")


@query("k15_combined_scoring", f"{B}{CM}{SC} SELECT asset, ts, h, round(100 * abs(close * exp(combined) - actual_close) / actual_close, 5) AS combined_error FROM sc")
def combined_scoring(spark, sf_dir):
    return scores(spark, sf_dir).select("asset", "ts", "h", F.round(100 * F.abs(F.col("predicted_close") - F.col("actual_close")) / F.col("actual_close"), 5).alias("combined_error"))


@query("k16_component_stats", f"""{B}, lo AS (UNPIVOT fc ON naive, drift, momentum, meanrev INTO NAME model VALUE predicted)
    SELECT asset, h, model, ts, round(avg(abs(predicted - ln(actual_close / close))) OVER (PARTITION BY asset, h, model ORDER BY ts ROWS UNBOUNDED PRECEDING), 6) AS running_error FROM lo WHERE actual_close IS NOT NULL""")
def component_stats(spark, sf_dir):
    rows = ops.long_form(made(spark, sf_dir)).where("actual_close IS NOT NULL")
    w = Window.partitionBy("asset", "h", "model").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return rounded(rows.select("asset", "h", "model", "ts", F.avg(F.abs(F.col("predicted") - F.ln(F.col("actual_close") / F.col("close")))).over(w).alias("running_error")))


@query("k17_latest_forecast", f"{B}{CM} SELECT asset, h, max(ts) AS made_at, round(arg_max(combined, ts), 6) AS combined FROM cm GROUP BY 1, 2")
def latest_forecast(spark, sf_dir):
    return rounded(ops.combine(made(spark, sf_dir)).groupBy("asset", "h").agg(F.max("ts").alias("made_at"), F.max_by("combined", "ts").alias("combined")))


@query("k18_history_vs_actual", f"{B}{CM} SELECT asset, h, target_ts, max(ts) AS made_at, round(arg_max(combined, ts), 6) AS combined, round(ln(arg_max(actual_close, ts) / arg_max(close, ts)), 6) AS actual_return FROM cm WHERE target_ts IS NOT NULL GROUP BY 1, 2, 3")
def history_vs_actual(spark, sf_dir):
    rows = ops.combine(made(spark, sf_dir)).where("target_ts IS NOT NULL")
    best = F.max_by(F.struct("ts", "combined", "close", "actual_close"), "ts").alias("_b")
    return rounded(rows.groupBy("asset", "h", "target_ts").agg(best).select("asset", "h", "target_ts", F.col("_b.ts").alias("made_at"), F.col("_b.combined").alias("combined"), F.ln(F.col("_b.actual_close") / F.col("_b.close")).alias("actual_return")))


@query("k19_accuracy", f"{B}{CM}{SC} SELECT h, count(*) AS n, round(avg(abs_pct_error), 5) AS mean_error, round(avg(CASE WHEN hit THEN 1.0 ELSE 0 END), 6) AS hit_rate FROM sc GROUP BY 1")
def accuracy(spark, sf_dir):
    return rounded(ops.accuracy(scores(spark, sf_dir), ["h"]), mean_error=5)


QU = """, d1 AS (SELECT *, row_number() OVER (PARTITION BY asset, h, CAST(target_ts AS DATE) ORDER BY ts DESC) AS q FROM sc),
    qu AS (SELECT asset, h, count(*) AS n, avg(abs_pct_error) AS mean_error, avg(CASE WHEN hit THEN 1.0 ELSE 0 END) AS hit_rate, avg(100 * abs(close - actual_close) / close) AS still_error FROM d1 WHERE q = 1 GROUP BY 1, 2 HAVING count(*) >= 30)"""


@query("k20_quality_ranking", f"{B}{CM}{SC}{QU} SELECT asset, h, n, round(mean_error, 5) AS mean_error, round(hit_rate, 6) AS hit_rate, round(still_error, 5) AS still_error, round(mean_error / still_error, 6) AS ratio FROM qu")
def quality_ranking(spark, sf_dir):
    return rounded(ops.quality(scores(spark, sf_dir), 30), mean_error=5, still_error=5)


@query("k21_horizon_overview", f"{B}{CM}{SC}{QU} SELECT h, count(*) AS assets, count(*) FILTER (mean_error / still_error < 1) AS carrying, round(list_sort(list(mean_error / still_error))[CAST(floor(count(*) / 2) AS INT) + 1], 6) AS median_ratio, min(n) AS min_n, max(n) AS max_n FROM qu GROUP BY 1")
def horizon_overview(spark, sf_dir):
    own_ = ops.quality(scores(spark, sf_dir), 30).groupBy("h").agg(F.count(F.lit(1)).alias("assets"), F.count_if(F.col("ratio") < 1).alias("carrying"), upper_median(F.collect_list("ratio")).alias("median_ratio"), F.min("n").alias("min_n"), F.max("n").alias("max_n"))
    return rounded(own_)


@query("k22_learning_curve", f"{B}{CM}{SC} SELECT CAST(date_trunc('month', target_ts) AS TIMESTAMP) AS month, h, round(median(abs_pct_error / nullif(100 * abs(close - actual_close) / close, 0)), 5) AS median_ratio, round(avg(CASE WHEN hit THEN 1.0 ELSE 0 END), 6) AS hit_rate, count(*) AS n FROM sc GROUP BY 1, 2")
def learning_curve(spark, sf_dir):
    rows = scores(spark, sf_dir).withColumn("_ratio", F.try_divide(F.col("abs_pct_error"), 100 * F.abs(F.col("close") - F.col("actual_close")) / F.col("close")))
    return rounded(rows.groupBy(F.date_trunc("month", "target_ts").alias("month"), "h").agg(F.percentile("_ratio", F.lit(0.5)).alias("median_ratio"), F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.count(F.lit(1)).alias("n")), median_ratio=5)


@query("k23_mix_vs_single", f"""{B}{CM}{SC}, j AS (SELECT sc.h, sc.abs_pct_error AS mix, 100 * abs(sc.close * exp(fc.drift) - sc.actual_close) / sc.close AS single FROM sc JOIN fc ON fc.asset = sc.asset AND fc.ts = sc.ts AND fc.h = sc.h)
    SELECT h, count(*) AS n, round(avg(mix), 5) AS mix_error, round(avg(single), 5) AS single_error, count(*) FILTER (mix < single) AS mix_better FROM j GROUP BY 1""")
def mix_vs_single(spark, sf_dir):
    own_ = made(spark, sf_dir)
    both = ops.scored(ops.combine(own_)).join(own_.select("asset", "ts", "h", "drift"), ["asset", "ts", "h"])
    both = both.withColumn("_s", 100 * F.abs(F.col("close") * F.exp("drift") - F.col("actual_close")) / F.col("close"))
    return rounded(both.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.avg("abs_pct_error").alias("mix_error"), F.avg("_s").alias("single_error"), F.count_if(F.col("abs_pct_error") < F.col("_s")).alias("mix_better")), 5)


@query("k25_sampled_backtest", f"{B}{CM}{SC} SELECT h, count(*) AS n, round(avg(abs_pct_error), 5) AS mean_error, round(avg(CASE WHEN hit THEN 1.0 ELSE 0 END), 6) AS hit_rate FROM sc WHERE rn % 10 = 0 AND rn >= 60 GROUP BY 1")
def sampled_backtest(spark, sf_dir):
    return rounded(ops.accuracy(scores(spark, sf_dir).where("rn % 10 = 0 AND rn >= 60"), ["h"]), mean_error=5)


@query("k27_pass_aggregates", f"{B}{CM}{SC} SELECT h, CAST(floor(rn / 50) AS BIGINT) AS bucket, count(*) AS n, round(avg(abs_pct_error), 5) AS mean_error, round(avg(CASE WHEN hit THEN 1.0 ELSE 0 END), 6) AS hit_rate FROM sc GROUP BY 1, 2")
def pass_aggregates(spark, sf_dir):
    return rounded(ops.accuracy(scores(spark, sf_dir).withColumn("bucket", F.floor(F.col("rn") / 50)), ["h", "bucket"]), mean_error=5)


@query("k33_freshness", f"{B} SELECT (SELECT max(ts) FROM bars) AS newest_bar, max(ts) AS newest_made, count(*) FILTER (ts = (SELECT max(ts) FROM fc)) AS made_then FROM fc")
def freshness(spark, sf_dir):
    rows = made(spark, sf_dir).groupBy("ts").agg(F.count(F.lit(1)).alias("_n"))
    newest = t.bars(spark, sf_dir, "week").agg(F.max("ts").alias("newest_bar"))
    return rows.agg(F.max("ts").alias("newest_made"), F.max_by("_n", "ts").alias("made_then")).join(F.broadcast(newest)).select("newest_bar", "newest_made", "made_then")


@query("k35_path_metrics", f"{B}{CM}{SC} SELECT h, count(*) AS n, round(avg(abs(combined - actual_return)), 6) AS mae, round(avg(abs(actual_return)), 6) AS naive_mae, round(avg(abs(combined - actual_return)) / avg(abs(actual_return)), 6) AS ratio, round(avg(combined - actual_return), 6) AS bias FROM sc WHERE rn % 5 = 0 GROUP BY 1")
def path_metrics(spark, sf_dir):
    mae, naive = F.avg(F.abs(F.col("combined") - F.col("actual_return"))), F.avg(F.abs("actual_return"))
    return rounded(scores(spark, sf_dir).where("rn % 5 = 0").groupBy("h").agg(F.count(F.lit(1)).alias("n"), mae.alias("mae"), naive.alias("naive_mae"), (mae / naive).alias("ratio"), F.avg(F.col("combined") - F.col("actual_return")).alias("bias")))


@query("j8_holdout_metrics", f"""{B}{CM}{SC} SELECT h, count(*) AS n, round(avg(abs(combined - actual_return)), 6) AS mae, round(avg(abs(actual_return)), 6) AS naive_mae, round(avg(CASE WHEN combined <> 0 AND sign(combined) = sign(actual_return) THEN 1.0 ELSE 0 END), 6) AS direction_hit,
    round(coalesce(corr(combined, actual_return), 0), 6) AS r FROM sc WHERE ts >= TIMESTAMP '2000-01-01' GROUP BY 1""")
def holdout_metrics(spark, sf_dir):
    from tidewater.functions.series import correlation

    called = (F.col("combined") != 0) & (F.signum("combined") == F.signum("actual_return"))
    rows = scores(spark, sf_dir).where("ts >= TIMESTAMP '2000-01-01'").groupBy("h")
    return rounded(rows.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("combined") - F.col("actual_return"))).alias("mae"), F.avg(F.abs("actual_return")).alias("naive_mae"), F.avg(called.cast("double")).alias("direction_hit"), correlation("combined", "actual_return").alias("r")))


@query("k24_history_listing", f"{B}{CM}{SC} SELECT asset, h, ts, round(100 * (exp(combined) - 1), 5) AS delta_pct, round(100 * (actual_close / close - 1), 5) AS move_pct FROM sc ORDER BY ts DESC, asset, h LIMIT 200")
def history_listing(spark, sf_dir):
    rows = scores(spark, sf_dir).orderBy(F.desc("ts"), "asset", "h").limit(200)
    return rounded(rows.select("asset", "h", "ts", (100 * (F.exp("combined") - 1)).alias("delta_pct"), (100 * (F.col("actual_close") / F.col("close") - 1)).alias("move_pct")), 5)


@query("k34_track_read", f"{B}{CM} SELECT asset, h, target_ts, ts, round(combined, 6) AS combined, target_ts < TIMESTAMP '2001-01-01' AS scored FROM cm WHERE asset = 'Brand#12' AND target_ts >= TIMESTAMP '2000-01-01'")
def track_read(spark, sf_dir):
    rows = ops.combine(made(spark, sf_dir).where("asset = 'Brand#12'")).where("target_ts >= TIMESTAMP '2000-01-01'")
    return rounded(rows.select("asset", "h", "target_ts", "ts", "combined", F.expr("target_ts < TIMESTAMP '2001-01-01'").alias("scored")))
