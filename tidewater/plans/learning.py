"""Features for learning (J of the inventory) and their export. Relations come from the weekly pair table, features from daily bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.series import own
from tidewater.operators import learning as ops
from tidewater.operators import pairs as pair_ops
from tidewater.sources import tables as t
from tidewater.sources.staging import written

from . import pairs as p
from .flow import flow
from .registry import query, rounded

REL = f"""{p.W_STATS}{p.LEAD}, nb AS (SELECT asset, other, r, place FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY round(abs(r), 9) DESC, other) AS place FROM ({p.BOTH}) WHERE round(abs(r), 9) > 0.05) WHERE place <= 8),
    le AS (SELECT asset, leader, lag, lag_corr, place FROM ld WHERE place <= 8)"""


def related(spark, sf_dir):
    """From the weekly pair table, which is written once, as are the bars that it is made of."""
    stats = written(p.stats(spark, sf_dir, written(t.bars(spark, sf_dir, "week"), "weeks")), "pairs")
    return ops.relations(pair_ops.mirrored(stats).select("asset", "other", "r"), pair_ops.leaders(stats, 8))


@query("j3_relations", f"{REL} SELECT asset, 'neighbour' AS relation, place, other, 0 AS lag, round(r, 6) AS weight FROM nb UNION ALL SELECT asset, 'leader', place, leader, lag, round(lag_corr, 6) FROM le")
def relations(spark, sf_dir):
    return rounded(related(spark, sf_dir))


LAGS = (*range(1, 13), 20)
W = "OVER (PARTITION BY asset ORDER BY ts ROWS {n} PRECEDING)"
Z20 = "OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
DAYS = "OVER (ORDER BY ts ROWS 19 PRECEDING)"
FEAT = f"""{REL}, {t.bars_sql('day', 'dbars')}, {t.ASSET_SQL},
    d0 AS (SELECT b.asset, b.ts, cls, close, row_number() OVER w AS i, CASE WHEN volume > 0 THEN CASE WHEN cls = 2 THEN volume ELSE close * volume END END AS gross, {', '.join(f'ln(close / lag(close, {n}) OVER w) AS r{n}' for n in LAGS)} FROM dbars b JOIN assets a ON a.asset = b.asset WINDOW w AS (PARTITION BY b.asset ORDER BY b.ts)),
    d1 AS (SELECT *, coalesce(r1, 0) AS r, gross / sum(gross) OVER (PARTITION BY ts) AS share FROM d0),
    ms AS (SELECT ts, avg(r) AS mkt_r1, avg(r5) AS mkt_r5, stddev_samp(r) AS mkt_disp, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) AS mkt_breadth, count(*) / (SELECT count(*) FROM assets) AS session_cov, {', '.join(f'coalesce(sum(CASE WHEN cls = {k} THEN gross END) / sum(gross), 0) AS s{k}' for k in ops.CLASSES)} FROM d1 GROUP BY 1),
    mk AS (SELECT *, sum(mkt_r1) {DAYS} AS m20, {', '.join(f's{k} / nullif(avg(s{k}) {DAYS}, 0) - 1 AS q{k}' for k in ops.CLASSES)} FROM ms),
    sn AS (SELECT nb.asset, x.ts, sum(nb.r * x.r1) / nullif(sum(abs(nb.r)), 0) AS nb_r1, sum(nb.r * coalesce(x.r5, 0)) / nullif(sum(abs(nb.r)), 0) AS nb_r5 FROM nb JOIN d1 x ON x.asset = nb.other WHERE x.r1 IS NOT NULL GROUP BY 1, 2),
    sl0 AS (SELECT le.asset, x.ts, lag_corr, CASE lag {' '.join(f'WHEN {n} THEN x.r{n}' for n in range(1, 13))} END AS v FROM le JOIN d1 x ON x.asset = le.leader),
    sl AS (SELECT asset, ts, sum(lag_corr * v) / nullif(sum(abs(lag_corr)), 0) AS lead_signal FROM sl0 WHERE v IS NOT NULL GROUP BY 1, 2),
    d2 AS (SELECT *, avg(r) OVER (PARTITION BY ts, cls) AS cls_r1, stddev_samp(r) {W.format(n=19)} AS vol20, stddev_samp(r) {W.format(n=59)} AS vol60, close / avg(close) {W.format(n=19)} - 1 AS ma20_dist, close / avg(close) {W.format(n=49)} - 1 AS ma50_dist,
      (ln(close) - avg(ln(close)) {W.format(n=49)}) / nullif(stddev_samp(ln(close)) {W.format(n=49)}, 0) AS z50, count(gross) {Z20} >= 5 AS enough,
      greatest(-10, least(10, (gross - avg(gross) {Z20}) / nullif(stddev_samp(gross) {Z20}, 0))) AS fz, greatest(-10, least(10, share / nullif(avg(share) {Z20}, 0) - 1)) AS fr FROM d1),
    ft AS (SELECT d2.asset, d2.ts, d2.cls, r1, r2, r3, r5, r10, r20, vol20, vol60, ma20_dist, ma50_dist, z50, CASE WHEN enough THEN fz END AS flow_z20, 10000 * share AS flow_share_bp, CASE WHEN enough THEN fr END AS flow_rot20, mkt_r1, mkt_r5, mkt_disp, mkt_breadth, session_cov, cls_r1,
      CASE cls {' '.join(f'WHEN {k} THEN s{k}' for k in ops.CLASSES)} END AS cls_share, CASE cls {' '.join(f'WHEN {k} THEN q{k}' for k in ops.CLASSES)} END AS cls_rot, nb_r1, nb_r5, lead_signal, r20 - m20 AS rel_str20,
      (cls = 0)::INT::DOUBLE AS is_stock, (cls = 1)::INT::DOUBLE AS is_etf, (cls = 2)::INT::DOUBLE AS is_crypto FROM d2 JOIN mk USING (ts) LEFT JOIN sn ON sn.asset = d2.asset AND sn.ts = d2.ts LEFT JOIN sl ON sl.asset = d2.asset AND sl.ts = d2.ts WHERE i > 70)"""
#: The 29 features, own moves, own flow, market, class, surroundings, kind.
NAMES = [
    "r1", "r2", "r3", "r5", "r10", "r20", "vol20", "vol60", "ma20_dist", "ma50_dist", "z50", "flow_z20", "flow_share_bp", "flow_rot20", "mkt_r1", "mkt_r5", "mkt_disp", "mkt_breadth", "session_cov",
    "cls_r1", "cls_share", "cls_rot", "nb_r1", "nb_r5", "lead_signal", "rel_str20", "is_stock", "is_etf", "is_crypto",
]
ROUNDED = ", ".join(f"round(coalesce({c}, 0), {4 if c == 'flow_share_bp' else 6}) AS {c}" for c in NAMES)


def features(spark, sf_dir, days):
    """Daily bars with their flow are written once, as many windows and groups read them."""
    n = t.assets(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
    rows = written(flow(spark, sf_dir, days), "flow")
    return ops.feature_rows(rows, related(spark, sf_dir), n).select("asset", "ts", "cls", *NAMES)


@query("j2_feature_rows", f"{FEAT} SELECT asset, ts, cls, {ROUNDED} FROM ft")
def feature_rows(spark, sf_dir):
    return rounded(features(spark, sf_dir, t.bars(spark, sf_dir)), flow_share_bp=4)


AHEAD = (1, 5, 20)


@query("a10_feature_matrix", f"""{FEAT}, ya AS (SELECT asset, ts, {', '.join(f'ln(lead(close, {h}) OVER w / close) AS y_h{h}' for h in AHEAD)} FROM dbars WINDOW w AS (PARTITION BY asset ORDER BY ts))
    SELECT asset, ts, cls, {ROUNDED}, {', '.join(f'round(y_h{h}, 6) AS y_h{h}' for h in AHEAD)} FROM ft JOIN ya USING (asset, ts) WHERE coalesce(y_h1, y_h5, y_h20) IS NOT NULL""")
def feature_matrix(spark, sf_dir):
    days = written(t.bars(spark, sf_dir), "days")
    targets = days.select("asset", "ts", *[F.ln(F.lead("close", h).over(own()) / F.col("close")).alias(f"y_h{h}") for h in AHEAD])
    return rounded(ops.feature_matrix(features(spark, sf_dir, days), targets), flow_share_bp=4)


@query("j6_cross_section", f"""WITH {t.WEEKLY_SQL}, x AS (SELECT asset, ts, ln(close / lag(close) OVER (PARTITION BY asset ORDER BY ts)) AS r FROM bars), n AS (SELECT count(DISTINCT asset) AS n FROM bars),
    dy AS (SELECT ts, (row_number() OVER (ORDER BY ts) - 1) / count(*) OVER () AS p FROM (SELECT ts FROM x GROUP BY ts HAVING count(r) >= 0.9 * (SELECT n FROM n))),
    dn AS (SELECT a.asset, dy.ts, p, coalesce(r, 0) AS r FROM dy CROSS JOIN (SELECT DISTINCT asset FROM bars) a LEFT JOIN x ON x.asset = a.asset AND x.ts = dy.ts)
    SELECT asset, ts, round(coalesce((r - avg(CASE WHEN p < 0.6 THEN r END) OVER w) / nullif(stddev_pop(CASE WHEN p < 0.6 THEN r END) OVER w, 0), 0), 6) AS x FROM dn WINDOW w AS (PARTITION BY asset)""")
def cross_section(spark, sf_dir):
    bars = t.bars(spark, sf_dir, "week")
    returns = bars.select("asset", "ts", F.ln(F.col("close") / F.lag("close").over(own())).alias("r"))
    return rounded(ops.cross_section(returns, bars.select("asset").distinct()))
