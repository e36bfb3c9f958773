"""Technical triggers (L of the inventory); l4_trigger_study is the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import triggers as ops
from tidewater.sources import tables as t

from .alignment import D
from .registry import query, rounded

WIN = "PARTITION BY asset ORDER BY ts"
IND = f""", i0 AS (SELECT *, row_number() OVER ({WIN}) AS rn, lag(close) OVER ({WIN}) AS before FROM bars),
    i1 AS (SELECT *, CASE WHEN rn >= 20 THEN avg(close) OVER ({WIN} ROWS 19 PRECEDING) END AS ma20, CASE WHEN rn >= 50 THEN avg(close) OVER ({WIN} ROWS 49 PRECEDING) END AS ma50, CASE WHEN rn >= 200 THEN avg(close) OVER ({WIN} ROWS 199 PRECEDING) END AS ma200,
      CASE WHEN rn >= 20 THEN stddev_samp(close) OVER ({WIN} ROWS 19 PRECEDING) END AS sd20, CASE WHEN rn >= 253 THEN max(close) OVER ({WIN} ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING) END AS high252,
      CASE WHEN rn >= 61 THEN avg(volume) OVER ({WIN} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) END AS volume60,
      CASE WHEN rn >= 15 THEN avg(greatest(close - before, 0)) OVER ({WIN} ROWS 13 PRECEDING) END AS u, CASE WHEN rn >= 15 THEN avg(greatest(before - close, 0)) OVER ({WIN} ROWS 13 PRECEDING) END AS d FROM i0),
    i2 AS (SELECT *, CASE WHEN d = 0 THEN 100.0 ELSE 100 - 100 / (1 + u / d) END AS rsi, ma50 - ma200 AS gap, volume / volume60 AS volume_factor FROM i1),
    i3 AS (SELECT *, lag(gap) OVER ({WIN}) AS gap_before, lag(rsi) OVER ({WIN}) AS rsi_before, lead(close, 1) OVER ({WIN}) / close - 1 AS fwd1, lead(close, 5) OVER ({WIN}) / close - 1 AS fwd5, lead(close, 20) OVER ({WIN}) / close - 1 AS fwd20 FROM i2)"""
TESTS = [
    ("golden_cross", 1, "gap_before <= 0 AND gap > 0"), ("death_cross", -1, "gap_before >= 0 AND gap < 0"), ("rsi_low", 1, "rsi_before >= 30 AND rsi < 30"), ("rsi_high", -1, "rsi_before <= 70 AND rsi > 70"),
    ("band_up", 1, "close > ma20 + 2 * sd20 AND before <= ma20 + 2 * sd20"), ("band_down", -1, "close < ma20 - 2 * sd20 AND before >= ma20 - 2 * sd20"), ("year_high", 1, "close > high252 AND before <= high252"),
]
TRIG = ", tr AS (" + " UNION ALL ".join(f"SELECT asset, ts, '{k}' AS kind, {d} AS direction, volume_factor, fwd1, fwd5, fwd20 FROM i3 WHERE {test}" for k, d, test in TESTS) + ")"
STUDY = f""", {t.ASSET_SQL}, ba AS (SELECT cls, median(fwd1) AS base1, median(fwd5) AS base5, median(fwd20) AS base20 FROM i3 JOIN assets USING (asset) GROUP BY 1),
    su AS (SELECT cls, kind, count(*) AS events, count(DISTINCT asset) AS assets, median(fwd1) AS median1, median(fwd5) AS median5, median(fwd20) AS median20, avg(CASE WHEN fwd5 IS NOT NULL THEN CASE WHEN sign(fwd5) = direction THEN 1.0 ELSE 0 END END) AS hit_rate, median(volume_factor) AS volume_factor FROM tr JOIN assets USING (asset) GROUP BY 1, 2)"""


def indicated(spark, sf_dir):
    return ops.indicators(t.bars(spark, sf_dir))


@query("l1_indicators", f"WITH {D}{IND} SELECT asset, ts, round(ma20, 3) AS ma20, round(ma50, 3) AS ma50, round(ma200, 3) AS ma200, round(sd20, 3) AS sd20, high252, round(volume60, 6) AS volume60, round(rsi, 4) AS rsi FROM i3")
def indicators(spark, sf_dir):
    own = indicated(spark, sf_dir)
    return own.select("asset", "ts", *[F.round(c, 3).alias(c) for c in ("ma20", "ma50", "ma200", "sd20")], "high252", F.round("volume60", 6).alias("volume60"), F.round("rsi", 4).alias("rsi"))


@query("l2_triggers", f"WITH {D}{IND}{TRIG} SELECT asset, ts, kind, direction, round(volume_factor, 6) AS volume_factor FROM tr")
def trigger_union(spark, sf_dir):
    return rounded(ops.triggers(indicated(spark, sf_dir)).select("asset", "ts", "kind", "direction", "volume_factor"))


@query("l3_active_triggers", f"WITH {D}{IND}{TRIG} SELECT asset, ts, kind, direction FROM tr WHERE ts >= (SELECT max(ts) FROM tr) - INTERVAL 30 DAY")
def active_triggers(spark, sf_dir):
    return ops.active(ops.triggers(indicated(spark, sf_dir)), 30).select("asset", "ts", "kind", "direction")


@query("l4_trigger_study", f"""WITH {D}{IND}{TRIG}{STUDY} SELECT su.cls, kind, events, assets, {', '.join(f'round(median{n}, 6) AS median{n}, round(base{n}, 6) AS base{n}' for n in (1, 5, 20))}, round(hit_rate, 6) AS hit_rate, round(volume_factor, 6) AS volume_factor FROM su JOIN ba USING (cls)""")
def trigger_study(spark, sf_dir):
    return rounded(ops.study(indicated(spark, sf_dir), t.assets(spark, sf_dir)))


@query("l5_trigger_report", f"""WITH {D}{IND}{TRIG}{STUDY} SELECT su.cls, kind, events, round(hit_rate, 6) AS hit_rate, {', '.join(f'round(median{n} - base{n}, 6) AS excess{n}' for n in (1, 5, 20))}, round(1.96 / sqrt(events), 6) AS threshold FROM su JOIN ba USING (cls)""")
def trigger_report(spark, sf_dir):
    return rounded(ops.report(ops.study(indicated(spark, sf_dir), t.assets(spark, sf_dir))))
