"""Contributions of single sources and the combined view (K11, K29, K30 of the inventory), on daily bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.operators import forecast as ops, pillars, text, triggers, verdicts as verdict_ops
from tidewater.sources import tables as t

from . import forecast as fc, text as tx, triggers as tr, walk
from .registry import query, rounded

#: Horizons in days, days that a trigger stays active, and those whose texts count.
DAYS, ACTIVE, NEWS = (1, 5, 20, 40), 30, 3
KNOW = f"""{tr.IND}{tr.TRIG}, {t.ASSET_SQL}, kb AS (SELECT cls, {", ".join(f"median(fwd{n}) AS base{n}" for n in (1, 5, 20))} FROM i3 JOIN assets USING (asset) GROUP BY 1),
    ke AS (SELECT cls, kind, {", ".join(f"median(fwd{n}) - any_value(base{n}) AS e{n}, avg(CASE WHEN fwd{n} IS NOT NULL THEN CASE WHEN sign(fwd{n}) = direction THEN 1.0 ELSE 0 END END) AS q{n}" for n in (1, 5, 20))} FROM tr JOIN assets USING (asset) JOIN kb USING (cls) GROUP BY 1, 2),
    ka AS (SELECT asset, kind, arg_max(direction, ts) AS direction FROM tr WHERE ts >= (SELECT max(ts) FROM tr) - INTERVAL {ACTIVE} DAY GROUP BY 1, 2),
    ki AS (SELECT asset, h, direction * CASE WHEN h <= 1 THEN e1 WHEN h <= 5 THEN e1 + (h - 1) / 4 * (e5 - e1) WHEN h <= 20 THEN e5 + (h - 5) / 15 * (e20 - e5) ELSE e20 END AS u,
      CASE WHEN h <= 1 THEN q1 WHEN h <= 5 THEN q1 + (h - 1) / 4 * (q5 - q1) WHEN h <= 20 THEN q5 + (h - 5) / 15 * (q20 - q5) ELSE 0.5 + (q20 - 0.5) * greatest(0, 1 - (h - 20) / 60) END AS q FROM ka JOIN assets USING (asset) JOIN ke USING (cls, kind) CROSS JOIN (SELECT unnest({list(DAYS)}) AS h)),
    km AS (SELECT asset, h, u, CASE WHEN u > 0 THEN coalesce(least(1, greatest(0, (abs(q - 0.5) - 0.02) / 0.08)), 0) ELSE 0 END AS m FROM ki),
    kn AS (SELECT asset, h, sum(u * m) / sum(m) AS value, least(1, sum(m) / count(*)) AS merit, count(*) AS patterns FROM km GROUP BY 1, 2 HAVING sum(m) > 1e-9)"""


def known(spark, sf_dir):
    indicated, classes = triggers.indicators(t.bars(spark, sf_dir)), t.assets(spark, sf_dir)
    return pillars.knowledge(triggers.active(triggers.triggers(indicated), ACTIVE), pillars.trigger_effects(indicated, classes), classes, DAYS)


@query("k29_knowledge_contribution", f"WITH {t.DAILY_SQL}{KNOW} SELECT asset, h, round(value, 6) AS value, round(merit, 6) AS merit, patterns FROM kn")
def knowledge_contribution(spark, sf_dir):
    return rounded(known(spark, sf_dir))


SEM = f"""sd AS (SELECT max(day) AS now FROM (SELECT (doc_id // 25) % 1000 + 1 AS day FROM documents)), sn AS (SELECT doc_id % 25 + 1 AS place, mood, (now - (doc_id // 25) % 1000 - 1) * 24 AS age_h FROM mo, sd WHERE now - (doc_id // 25) % 1000 - 1 <= {NEWS}),
    sa AS (SELECT ab.asset, sum(mood * pow(0.5, age_h / 24)) / sum(pow(0.5, age_h / 24)) AS mood, count(*) AS texts FROM sn JOIN ab USING (place) GROUP BY 1),
    sk AS (SELECT h, CASE WHEN n >= 30 AND abs(r) > threshold THEN slope ELSE 0 END AS slope, CASE WHEN n >= 30 THEN least(1, greatest(0, (abs(r) - threshold) / 0.1)) ELSE 0 END AS skill FROM c),
    se AS (SELECT asset, h, mood * slope AS value, skill AS merit, texts, mood FROM sa CROSS JOIN sk)"""


def meant(spark, sf_dir):
    """Moods of the newest days' texts; as in the calibration, asset and day follow from doc_id."""
    own = tx.docs(spark, sf_dir)
    day = F.floor(F.col("doc_id") / 25) % 1000 + 1
    now = own.agg(F.max(day).alias("_now"))
    places = t.bars(spark, sf_dir).where("close > 0").select("asset").distinct().withColumn("place", F.row_number().over(Window.orderBy("asset")))
    moods = text.sentiment(own, tx.lexicon(spark)).withColumn("_day", day).crossJoin(now).where(F.col("_now") - F.col("_day") <= NEWS)
    rows = moods.select((F.col("doc_id") % 25 + 1).alias("place"), "mood", ((F.col("_now") - F.col("_day")) * 24).alias("age_h")).join(places, "place")
    return pillars.semantic(text.decayed(rows), tx.calibrated(spark, sf_dir))


@query("k30_semantic_contribution", f"{tx.CALIB}, {SEM} SELECT asset, h, round(value, 6) AS value, round(merit, 6) AS merit, texts FROM se")
def semantic_contribution(spark, sf_dir):
    return rounded(meant(spark, sf_dir))


#: Weights of the pillars.
SLIDERS = {"knowledge": 40, "learning": 100, "reasoning": 50, "semantic": 30}
VIEW = f"""{tx.CALIB}, {SEM}{KNOW}{fc.FC}{fc.CM}{fc.SC}, {walk.VERDICT.removeprefix(t.DAILY_SQL + ', ')}, nw AS (SELECT max(asked) AS now FROM vd),
    vm AS (SELECT CASE WHEN count(*) < 20 THEN 0.25 ELSE least(1, greatest(0, (avg(CASE WHEN hit THEN 1.0 ELSE 0 END) - 0.5) / 0.2)) END AS merit FROM vs WHERE direction <> 0),
    nv AS (SELECT asset, direction, confidence FROM vd, nw WHERE asked >= now - INTERVAL 3 DAY QUALIFY row_number() OVER (PARTITION BY asset ORDER BY asked DESC, verdict_id DESC) = 1),
    sg AS (SELECT asset, stddev_samp(r) AS s FROM (SELECT asset, ts, ln(close / lag(close) OVER (PARTITION BY asset ORDER BY ts)) AS r FROM bn, nw WHERE ts >= now - INTERVAL 180 DAY) GROUP BY 1),
    le AS (SELECT asset, h, combined AS value, merit FROM (SELECT * FROM cm QUALIFY row_number() OVER (PARTITION BY asset, h ORDER BY ts DESC) = 1) JOIN (SELECT asset, h, CASE WHEN count(*) >= 20 THEN least(1, greatest(0, (avg(CASE WHEN hit THEN 1.0 ELSE 0 END) - 0.523) / 0.10)) ELSE 0.25 END AS merit FROM sc GROUP BY 1, 2) USING (asset, h)),
    co AS (SELECT asset, h, 'learning' AS pillar, value, {SLIDERS['learning']} AS w, merit FROM le UNION ALL SELECT asset, h, 'knowledge', value, {SLIDERS['knowledge']}, merit FROM kn UNION ALL SELECT asset, h, 'semantic', value, {SLIDERS['semantic']}, merit FROM se
      UNION ALL SELECT nv.asset, h, 'reasoning', direction / 2 * confidence * s * sqrt(h), {SLIDERS['reasoning']}, merit FROM nv JOIN sg USING (asset) CROSS JOIN vm CROSS JOIN (SELECT unnest([1, 5, 20]) AS h) WHERE direction <> 0 AND s > 0),
    cs AS (SELECT *, sum(w * merit) OVER p AS sw, sum(w) OVER p AS sv, count(*) OVER p AS n FROM co WINDOW p AS (PARTITION BY asset, h)), ch AS (SELECT *, CASE WHEN sw > 1e-9 THEN w * merit / sw WHEN sv > 0 THEN w / sv ELSE 1 / n END AS share FROM cs)"""


def contributions(spark, sf_dir):
    """What all pillars say on daily bars: asset, h, pillar, value, weight, merit."""
    bars = t.bars(spark, sf_dir)
    made = ops.combine(ops.forecasts(bars, fc.H))
    past = ops.scored(made).groupBy("asset", "h").agg(F.avg(F.col("hit").cast("double")).alias("_q"), F.count(F.lit(1)).alias("_n"))
    latest = made.groupBy("asset", "h").agg(F.max_by("combined", "ts").alias("value")).join(past, ["asset", "h"]).withColumn("merit", ops.own_merit(F.col("_q"), F.col("_n")))
    given = walk.verdicts(spark, sf_dir)
    reasoned = verdict_ops.contributions(given, bars, verdict_ops.merit(verdict_ops.scored(given, bars)), fc.H)
    each = {"learning": latest, "reasoning": reasoned, "knowledge": known(spark, sf_dir), "semantic": meant(spark, sf_dir)}
    rows = [df.select("asset", "h", F.lit(name).alias("pillar"), "value", F.lit(SLIDERS[name]).alias("weight"), "merit") for name, df in each.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query("k11_combined_view", f"""{VIEW} SELECT asset, h, round(sum(value * share), 6) AS value, round(max(sw) / 100, 4) AS effective, count(*) AS pillars, count(*) FILTER (merit > 0) AS carried,
    CASE WHEN max(sw) > 1e-9 THEN CASE WHEN count(*) FILTER (merit > 0) = 1 THEN 'one' ELSE 'several' END WHEN max(sv) > 0 THEN 'weights' ELSE 'equal' END AS verdict FROM ch GROUP BY 1, 2""")
def combined_view(spark, sf_dir):
    return rounded(pillars.combined_view(contributions(spark, sf_dir)).drop("trace"), effective=4)


@query("k11_combined_trace", f"{VIEW} SELECT asset, h, pillar, round(value, 6) AS value, round(merit, 6) AS merit, round(share, 6) AS share FROM ch")
def combined_trace(spark, sf_dir):
    return rounded(pillars.combined_view(contributions(spark, sf_dir)).select("asset", "h", F.explode("trace").alias("_t")).select("asset", "h", "_t.*"))
