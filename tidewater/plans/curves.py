"""Events and curve analysis (G of the inventory), spectra (H) and features for learning (J)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.functions.series import own
from tidewater.operators import curve, events as ops, flow as flows, spectral
from tidewater.operators.bars import log_returns
from tidewater.sources import tables as t
from tidewater.sources.staging import new_folder, written

from .alignment import D, RET, WK
from .flow import NEUTRAL
from .registry import query, rounded

A = t.ASSET_SQL
SEV = "least(100, greatest(1, round_even(100 * (1 - exp(-({m}) / 4)), 0)))"
EV = f"""{RET}, e0 AS (SELECT b.*, r, row_number() OVER (PARTITION BY b.asset ORDER BY b.ts) AS i, (high - low) / b.close AS rng FROM bars b JOIN ret USING (asset, ts)),
    e1 AS (SELECT *, median(abs(r)) OVER w AS mr, median(volume) OVER w AS mv, median(rng) OVER w AS mg FROM e0 WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
    e2 AS (SELECT *, abs(r) / (1.4826 * mr) AS z, coalesce(volume / CASE WHEN mv > 0 THEN mv END, 1) AS vf, coalesce(rng / CASE WHEN mg > 0 THEN mg END - 1, 0) AS rz FROM e1 WHERE i > 61 AND mr > 1e-9),
    e3 AS (SELECT *, CASE WHEN vf > 0 THEN log2(vf) ELSE 0 END AS dbl FROM e2), e4 AS (SELECT *, z + 0.6 * greatest(0, least(4, dbl)) + 0.3 * greatest(0, least(3, rz)) AS mag FROM e3),
    me AS (SELECT asset, ts, z, mag, {SEV.format(m='mag')} AS severity, CASE WHEN z >= 3 AND dbl >= 1.5 THEN 'move_on_volume' WHEN z >= 3 THEN 'move' WHEN dbl >= 1.5 THEN 'volume' WHEN rz > 0.5 THEN 'range' ELSE 'mixed' END AS kind, CAST(sign(r) AS INT) AS direction, z >= 10 AND vf < 1.5 AS suspect, dbl FROM e4)"""


@query("g1_market_events", f"WITH {D}{EV} SELECT asset, ts, round(z, 5) AS z, round(mag, 5) AS magnitude, CAST(severity AS DOUBLE) AS severity, kind, direction, suspect FROM me WHERE severity >= 40 AND NOT (z < 2 AND dbl < 2)")
def market_events(spark, sf_dir):
    return rounded(ops.market_events(t.bars(spark, sf_dir)), 5)


@query("g2_severity_scale", f"WITH {D}{RET} SELECT asset, ts, CAST({SEV.format(m='abs(r) * 10')} AS DOUBLE) AS severity FROM ret")
def severity_scale(spark, sf_dir):
    from tidewater.functions.series import severity

    return log_returns(t.bars(spark, sf_dir)).select("asset", "ts", severity(F.abs("r") * 10).alias("severity"))


def greedy(events: str, keys: str, gap: int, name: str) -> str:
    """SQL of what is left of events (keys, i, ...) when each kept one shuts out the next ``gap`` positions: the chain from each key's first event."""
    same = " AND ".join(f"n.{k} = e.{k}" for k in keys.split(", "))
    return f"""{name}_n AS MATERIALIZED (SELECT e.*, n.i AS following FROM {events} e ASOF LEFT JOIN (SELECT {keys}, i FROM {events}) n ON {same} AND e.i + {gap} <= n.i),
    {name} AS (SELECT * FROM {name}_n WHERE ({keys}, i) IN (SELECT ({keys}, min(i)) FROM {events} GROUP BY {keys}) UNION ALL SELECT n.* FROM {name} e JOIN {name}_n n ON {same} AND n.i = e.following)"""


DERIVED = f"""WITH RECURSIVE {D}, lx AS MATERIALIZED (SELECT asset, ts, ln(close) AS x, row_number() OVER (PARTITION BY asset ORDER BY ts) AS i FROM bars WHERE close > 0),
    sm AS (SELECT asset, ts, i, x AS s FROM lx WHERE i = 1 UNION ALL SELECT lx.asset, lx.ts, lx.i, s + (2 / 11) * (lx.x - s) FROM sm JOIN lx ON lx.asset = sm.asset AND lx.i = sm.i + 1), sd AS (SELECT *, s - lag(s) OVER (PARTITION BY asset ORDER BY i) AS d FROM sm),
    sz AS (SELECT *, CASE WHEN count(d) OVER w = 120 THEN median(abs(d)) OVER w END AS m FROM sd WINDOW w AS (PARTITION BY asset ORDER BY i ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING)),
    de AS (SELECT asset, i, ts, abs(d) / (m * 1.4826) AS z, CAST(sign(d) AS INT) AS sign FROM sz WHERE m > 1e-12 AND abs(d) / (m * 1.4826) >= 3), {greedy('de', 'asset', 10, 'dk')}"""


@query("g3_derivative_events", f"{DERIVED} SELECT asset, i, ts, round(z, 6) AS z, sign FROM dk")
def derivative_events(spark, sf_dir):
    return rounded(curve.derivative_events(t.bars(spark, sf_dir)))


K0, K1, K2 = curve.kernels(5)


def _weighed(weights):
    return " + ".join(f"({w!r}) * " + (f"lag(x, {-j}) OVER q" if j < 0 else "x" if j == 0 else f"lead(x, {j}) OVER q") for w, j in zip(weights, range(-5, 6), strict=True))


@query("g4_local_quadratic", f"""WITH {WK}, l AS (SELECT asset, ts, ln(close) AS x FROM bars WHERE close > 0) SELECT asset, ts, round(coalesce({_weighed(K0)}, x), 6) AS value, round({_weighed(K1)}, 6) AS slope, round({_weighed(K2)}, 6) AS curvature FROM l WINDOW q AS (PARTITION BY asset ORDER BY ts)""")
def local_quadratic(spark, sf_dir):
    return rounded(curve.local_quadratic(t.bars(spark, sf_dir, "week"), 5).select("asset", "ts", "value", "slope", "curvature"))


PARTS = ("slope", "curvature", "residual")
KINDS = {
    "high": ("s0 * slope < 0 AND z_curvature IS NOT NULL AND curvature < 0", "z_curvature"), "low": ("s0 * slope < 0 AND z_curvature IS NOT NULL AND curvature > 0", "z_curvature"), "inflection": ("c0 * curvature < 0", "z_slope"),
    "saddle": ("z_slope < 0.35 AND z_curvature < 0.35 AND zs >= 2.5", "zs"), "slope_break": ("z_slope >= 2.5", "z_slope"), "curvature_break": ("z_curvature >= 2.5", "z_curvature"), "jump": ("z_residual >= 3.5", "z_residual"),
}
FEATURES = f"""WITH RECURSIVE {D}, lx AS (SELECT asset, ts, ln(close) AS x, row_number() OVER (PARTITION BY asset ORDER BY ts) AS i FROM bars WHERE close > 0),
    lf AS (SELECT asset, ts, i, {_weighed(K1)} AS slope, {_weighed(K2)} AS curvature, x - coalesce({_weighed(K0)}, x) AS residual FROM lx WINDOW q AS (PARTITION BY asset ORDER BY ts)),
    lm AS (SELECT *, {", ".join(f"list_sort(list_filter(list(abs({c})) OVER w, lambda v: v > 0)) AS m_{c}" for c in PARTS)} FROM lf WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)),
    lz AS (SELECT *, {", ".join(f"CASE WHEN len(m_{c}) >= 125 AND m_{c}[len(m_{c}) // 2 + 1] > 1e-12 THEN abs({c}) / (m_{c}[len(m_{c}) // 2 + 1] * 1.4826) END AS z_{c}" for c in PARTS)} FROM lm),
    lw AS (SELECT asset, ts, i, slope, curvature, {", ".join(f"z_{c}" for c in PARTS)}, lag(slope) OVER p AS s0, lag(curvature) OVER p AS c0, max(z_slope) OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS zs FROM lz WINDOW p AS (PARTITION BY asset ORDER BY ts)),
    le AS ({" UNION ALL ".join(f"SELECT asset, '{k}' AS kind, i, ts, {z} AS z FROM lw WHERE {test} AND {z} IS NOT NULL" for k, (test, z) in KINDS.items())}),
    ls AS (SELECT *, {SEV.format(m='z')} AS severity FROM le), lv AS (SELECT * FROM ls WHERE severity >= 20), {greedy('lv', 'asset, kind', 5, 'cf')}"""
LINKS = """, dy AS (SELECT ts, row_number() OVER (ORDER BY ts) AS d FROM (SELECT DISTINCT ts FROM bars)), cd AS (SELECT x.asset AS a, y.asset AS b, count(*) AS days FROM bars x JOIN bars y ON x.ts = y.ts AND x.asset < y.asset GROUP BY 1, 2 HAVING count(*) >= 200),
    pl AS (SELECT asset, kind, d FROM cf JOIN dy USING (ts)), ct AS (SELECT asset, kind, count(*) AS n FROM pl GROUP BY 1, 2), nb AS (SELECT asset, kind, d, unnest(range(d - 3, d + 4)) AS at FROM pl),
    lk AS (SELECT x.asset AS a, y.asset AS b, x.kind AS kind_a, y.kind AS kind_b, y.d - x.d AS lag FROM pl x JOIN nb y ON y.at = x.d AND x.asset < y.asset),
    lg AS (SELECT a, b, kind_a, kind_b, count(*) AS pairs, list_sort(list(lag))[count(*) // 2 + 1] AS median_lag, avg(CASE WHEN lag > 0 THEN 1.0 ELSE 0 END) AS lead_share FROM lk GROUP BY 1, 2, 3, 4 HAVING count(*) >= 8),
    ll AS (SELECT lg.a, lg.b, kind_a, kind_b, pairs, x.n * y.n * 7 / days AS expected, pairs / (x.n * y.n * 7 / days) AS lift, median_lag, lead_share FROM lg JOIN cd ON cd.a = lg.a AND cd.b = lg.b JOIN ct x ON x.asset = lg.a AND x.kind = kind_a JOIN ct y ON y.asset = lg.b AND y.kind = kind_b),
    ln_ AS (SELECT * FROM ll WHERE lift >= 1.0)"""


@query("g5_curve_features", f"{FEATURES} SELECT asset, kind, i, ts, round(z, 6) AS z, severity FROM cf")
def curve_features(spark, sf_dir):
    return rounded(curve.curve_features(t.bars(spark, sf_dir)))


@query("g6_event_links", f"{FEATURES}{LINKS} SELECT a, b, kind_a, kind_b, pairs, round(expected, 6) AS expected, round(lift, 6) AS lift, median_lag, round(lead_share, 6) AS lead_share FROM ln_")
def event_links(spark, sf_dir):
    bars = t.bars(spark, sf_dir)
    return rounded(curve.link_events(curve.curve_features(bars), bars.select("asset", "ts"), least_lift=1.0))


def curve_run(spark, sf_dir):
    """A run over the daily bars, written into its three tables: the folder, and the headers there."""
    at = new_folder(spark, "curves")
    return at, curve.curve_run(written(t.bars(spark, sf_dir), "days"), at, "daily", least_lift=1.0)


@query("g7_curve_run", f"{FEATURES}{LINKS} SELECT 'daily' AS run, count(DISTINCT asset) AS assets, count(*) AS bars, min(ts) AS first_ts, max(ts) AS last_ts, (SELECT count(*) FROM cf) AS events, (SELECT count(*) FROM ln_) AS links FROM bars")
def curve_run_header(spark, sf_dir):
    return curve_run(spark, sf_dir)[1].select("run", "assets", "bars", "first_ts", "last_ts", "events", "links")


@query("g9_type_statistics", f"{FEATURES} SELECT kind, count(*) AS n, count(DISTINCT asset) AS assets, round(avg(severity), 6) AS mean_severity, round(max(z), 6) AS max_z FROM cf GROUP BY 1")
def type_statistics(spark, sf_dir):
    at, _ = curve_run(spark, sf_dir)
    return rounded(curve.type_statistics(spark.read.parquet(f"{at}/events").where("run = 'daily'")))


@query("g9_link_list", f"{FEATURES}{LINKS} SELECT a, b, kind_a, kind_b, pairs, round(lift, 6) AS lift FROM ln_ ORDER BY round(lift, 9) DESC, a, b, kind_a, kind_b LIMIT 50")
def link_list(spark, sf_dir):
    at, _ = curve_run(spark, sf_dir)
    return rounded(curve.strongest_links(spark.read.parquet(f"{at}/links").where("run = 'daily'"), 50).select("a", "b", "kind_a", "kind_b", "pairs", "lift"))


TRAN = f"""{NEUTRAL}, lead_ev AS (SELECT asset AS leader, ts, sign(r) AS sign FROM ret WHERE abs(r) > 2),
    mt AS (SELECT leader, ah.asset AS follower, lead_ev.ts, sign * ahead AS x FROM lead_ev JOIN ah ON ah.ts = lead_ev.ts AND ah.asset <> leader WHERE ahead IS NOT NULL)"""
MEAS = "SELECT leader, follower, count(*) AS n, avg(x) AS mean, greatest(avg(CASE WHEN x > 0 THEN 1.0 ELSE 0 END), 1 - avg(CASE WHEN x > 0 THEN 1.0 ELSE 0 END)) AS consistency, avg(x) / (stddev_samp(x) / sqrt(count(*))) AS t FROM mt {w} GROUP BY 1, 2 HAVING count(*) >= 12"
SHUFFLED = "SELECT asset AS leader, ts, sign(r) AS sign FROM ret QUALIFY row_number() OVER (PARTITION BY asset ORDER BY md5(asset || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S')), ts) <= count(*) FILTER (abs(r) > 2) OVER (PARTITION BY asset)"
SPLIT = "TIMESTAMP '1999-01-01 00:00:00'"


def transmitted(spark, sf_dir, where="true"):
    rows = flows.forward_sum(flows.market_neutral(t.bars(spark, sf_dir)), "neutral", 10).where(where)
    events = rows.where(F.abs("r") > 2).select(F.col("asset").alias("leader"), "ts", F.signum("r").alias("sign"))
    return ops.transmission(events, rows.select(F.col("asset").alias("follower"), "ts", "ahead"))


@query("g11_transmission", f"WITH {D}{TRAN}, m AS ({MEAS.format(w='')}) SELECT leader, follower, n, round(mean, 6) AS mean, round(consistency, 6) AS consistency, round(t, 5) AS t FROM m")
def transmission(spark, sf_dir):
    return rounded(transmitted(spark, sf_dir), t=5)


@query("g12_confirmation", f"""WITH {D}{TRAN}, tr AS ({MEAS.format(w='WHERE ts < ' + SPLIT)}), te AS ({MEAS.format(w='WHERE ts >= ' + SPLIT)}), b AS (SELECT * FROM tr WHERE abs(t) >= 2 ORDER BY round(abs(t), 9) DESC, leader, follower LIMIT 30)
    SELECT count(*) AS links, round(avg(CASE WHEN sign(b.mean) = sign(te.mean) THEN 1.0 ELSE 0 END), 6) AS same_sign FROM b JOIN te USING (leader, follower)""")
def confirmation(spark, sf_dir):
    return rounded(ops.confirmed(transmitted(spark, sf_dir, f"ts < {SPLIT}"), transmitted(spark, sf_dir, f"ts >= {SPLIT}"), 30))


@query("g13_shuffle_control", f"WITH {D}{TRAN.replace('SELECT asset AS leader, ts, sign(r) AS sign FROM ret WHERE abs(r) > 2', SHUFFLED)}, m AS ({MEAS.format(w='')}) SELECT leader, follower, n, round(mean, 6) AS mean, round(consistency, 6) AS consistency, round(t, 5) AS t FROM m")
def shuffle_control(spark, sf_dir):
    rows = flows.forward_sum(flows.market_neutral(t.bars(spark, sf_dir)), "neutral", 10)
    return rounded(ops.transmission(ops.shuffled_events(rows.select("asset", "ts", "r"), 2.0), rows.select(F.col("asset").alias("follower"), "ts", "ahead")), t=5)


@query("g14_transmission_scan", f"""WITH {D}{TRAN}, tr AS ({MEAS.format(w='WHERE ts < ' + SPLIT)}), te AS ({MEAS.format(w='WHERE ts >= ' + SPLIT)}), b AS (SELECT * FROM tr WHERE abs(t) >= 2 ORDER BY round(abs(t), 9) DESC, leader, follower LIMIT 100)
    SELECT b.leader, b.follower, b.n, round(b.t, 5) AS t, round(te.t, 5) AS t_test, CASE WHEN te.mean IS NULL THEN 'untested' WHEN sign(b.mean) = sign(te.mean) AND abs(te.t) >= 2 THEN 'confirmed' WHEN sign(b.mean) = sign(te.mean) THEN 'weak' ELSE 'refuted' END AS verdict FROM b LEFT JOIN te ON te.leader = b.leader AND te.follower = b.follower""")
def transmission_scan(spark, sf_dir):
    return rounded(scanned(spark, sf_dir).drop("mean", "mean_test"), 5)


def scanned(spark, sf_dir):
    return ops.scan(transmitted(spark, sf_dir, f"ts < {SPLIT}"), transmitted(spark, sf_dir, f"ts >= {SPLIT}"), 100)


@query("g14_scan_verdict", f"""WITH {D}{TRAN}, tr AS ({MEAS.format(w='WHERE ts < ' + SPLIT)}), te AS ({MEAS.format(w='WHERE ts >= ' + SPLIT)}), b AS (SELECT * FROM tr WHERE abs(t) >= 2 ORDER BY round(abs(t), 9) DESC, leader, follower LIMIT 100),
    j AS (SELECT b.t, b.mean, te.mean AS m2 FROM b LEFT JOIN te ON te.leader = b.leader AND te.follower = b.follower), v AS (SELECT count(m2) AS checked, count(*) FILTER (sign(mean) = sign(m2)) AS same, avg(abs(t)) FILTER (m2 IS NOT NULL) AS mean_t, avg(sign(mean) * m2) AS mean_test FROM j)
    SELECT checked, same, round(100 * same / nullif(checked, 0), 5) AS share, round(mean_t, 5) AS mean_t, round(mean_test, 5) AS mean_test, CASE WHEN checked < 10 THEN 'too_few' WHEN 100 * same / checked >= 60 AND mean_test > 0 THEN 'repeated' WHEN 100 * same / checked >= 55 THEN 'weak' ELSE 'not_repeated' END AS verdict FROM v""")
def scan_verdict(spark, sf_dir):
    return rounded(ops.scan_verdict(scanned(spark, sf_dir)), 5)


@query("g8_event_page", f"WITH {D}{EV}, f AS (SELECT asset, ts, kind, severity FROM me WHERE severity >= 40 AND NOT (z < 2 AND dbl < 2) AND kind <> 'mixed' AND severity >= 60) SELECT asset, ts, kind, CAST(severity AS DOUBLE) AS severity, (SELECT count(*) FROM f) AS total FROM f ORDER BY severity DESC, ts DESC, asset LIMIT 25 OFFSET 25")
def event_page(spark, sf_dir):
    found = ops.market_events(t.bars(spark, sf_dir)).where("kind <> 'mixed' AND severity >= 60").select("asset", "ts", "kind", "severity")
    page = found.orderBy(F.desc("severity"), F.desc("ts"), "asset").offset(25).limit(25)
    return page.join(F.broadcast(found.agg(F.count(F.lit(1)).alias("total"))))


def shapes(spark, sf_dir):
    return ops.shape_windows(t.bars(spark, sf_dir, "week"), 30, 5, 5)


@query("g15_shape_windows", f"""WITH {WK}, l AS (SELECT asset, ts, ln(close) AS x, row_number() OVER p AS i, lead(ln(close), 5) OVER p - ln(close) AS forward FROM bars WHERE close > 0 WINDOW p AS (PARTITION BY asset ORDER BY ts)),
    v AS (SELECT asset, ts, i, forward, list(x) OVER w AS v, avg(x) OVER w AS m, stddev_pop(x) OVER w AS s FROM l WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS 29 PRECEDING)), k AS (SELECT asset, ts, forward, unnest(v) AS x, generate_subscripts(v, 1) AS place, m, s FROM v WHERE len(v) = 30 AND i % 5 = 0 AND s > 1e-12)
    SELECT asset, ts, place, round((x - m) / s, 6) AS value, round(forward, 6) AS forward FROM k""")
def shape_windows(spark, sf_dir):
    return rounded(shapes(spark, sf_dir).select("asset", "ts", F.posexplode("shape").alias("place", "value"), "forward").withColumn("place", F.col("place") + 1))


def latest_shapes(spark, sf_dir):
    own_ = shapes(spark, sf_dir)
    last = own_.withColumn("_n", F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("i")))).where("_n = 1")
    return ops.similar_shapes(last, own_, 20, 30)


SHAPES = f"""WITH {WK}, l AS (SELECT asset, ts, ln(close) AS x, row_number() OVER p AS i, lead(ln(close), 5) OVER p - ln(close) AS forward FROM bars WHERE close > 0 WINDOW p AS (PARTITION BY asset ORDER BY ts)),
    s0 AS (SELECT asset, i, forward, list(x) OVER w AS v, avg(x) OVER w AS m, stddev_pop(x) OVER w AS s FROM l WINDOW w AS (PARTITION BY asset ORDER BY i ROWS 29 PRECEDING)), s1 AS (SELECT asset, i, forward, list_transform(v, lambda x: (x - m) / s) AS shape FROM s0 WHERE len(v) = 30 AND i % 5 = 0 AND s > 1e-12),
    q AS (SELECT asset AS q_asset, i AS q_i, shape AS q FROM s1 QUALIFY row_number() OVER (PARTITION BY asset ORDER BY i DESC) = 1), c AS (SELECT q_asset, q_i, asset, i, forward, list_inner_product(shape, q) / 30 AS r FROM s1 JOIN q ON asset <> q_asset OR abs(i - q_i) >= 30),
    sm AS (SELECT *, row_number() OVER (PARTITION BY q_asset, q_i ORDER BY round(r, 9) DESC, asset, i) AS rank FROM c QUALIFY rank <= 20)"""


@query("g16_similar_shapes", f"{SHAPES} SELECT q_asset, q_i, asset, i, round(forward, 6) AS forward, round(r, 6) AS r, rank FROM sm")
def similar_shapes(spark, sf_dir):
    return rounded(latest_shapes(spark, sf_dir))


@query("g17_shape_consensus", f"{SHAPES} SELECT q_asset, q_i, count(*) AS n, round(avg(forward), 6) AS mean_forward, round(greatest(avg(CASE WHEN forward > 0 THEN 1.0 ELSE 0 END), 1 - avg(CASE WHEN forward > 0 THEN 1.0 ELSE 0 END)), 6) AS agreement FROM sm WHERE r >= 0.5 AND forward IS NOT NULL GROUP BY 1, 2")
def shape_consensus(spark, sf_dir):
    return rounded(ops.consensus(latest_shapes(spark, sf_dir), 0.5))


DET = """, dx AS (SELECT asset, ts, row_number() OVER (PARTITION BY asset ORDER BY ts) - 1 AS i, ln(close) AS y FROM bars WHERE close > 0), dl AS (SELECT asset, regr_slope(y, i) AS b, regr_intercept(y, i) AS a FROM dx GROUP BY 1), de AS (SELECT asset, ts, i, y - a - b * i AS x FROM dx JOIN dl USING (asset))"""


@query("h1_detrended", f"WITH {WK}{DET} SELECT asset, ts, i, round(x, 6) AS x FROM de")
def detrended(spark, sf_dir):
    return rounded(spectral.detrended(t.bars(spark, sf_dir, "week")))


SEGMENT = 128
FOU = f""", sg AS (SELECT asset, i, x, unnest([i // {SEGMENT // 2} - 1, i // {SEGMENT // 2}]) AS seg FROM de), s2 AS (SELECT *, i - seg * {SEGMENT // 2} AS j, count(*) OVER (PARTITION BY asset, seg) AS n, avg(x) OVER (PARTITION BY asset, seg) AS m FROM sg WHERE seg >= 0),
    s3 AS (SELECT asset, seg, j, 0.5 - 0.5 * cos(2 * pi() * j / {SEGMENT - 1}) AS w, x - m AS c FROM s2 WHERE n = {SEGMENT}), kk AS (SELECT unnest(range(12, 129)) AS k),
    fo AS (SELECT asset, seg, k, sum(w * c * cos(2 * pi() * k * j / {4 * SEGMENT})) / sqrt(sum(w * w)) AS re, sum(w * c * sin(2 * pi() * k * j / {4 * SEGMENT})) / sqrt(sum(w * w)) AS im FROM s3 CROSS JOIN kk GROUP BY 1, 2, 3),
    we AS (SELECT asset, k, avg(re * re + im * im) AS power FROM fo GROUP BY 1, 2)"""


def transformed(spark, sf_dir):
    return spectral.fourier(spectral.detrended(t.bars(spark, sf_dir, "week")), range(12, 129), SEGMENT)


@query("h3_welch_spectrum", f"WITH {WK}{DET}{FOU} SELECT asset, k, round(power, 6) AS power FROM we")
def welch_spectrum(spark, sf_dir):
    return rounded(spectral.welch(transformed(spark, sf_dir)))


@query("h4_spectrum_summary", f"""WITH {WK}{DET}{FOU}, r AS (SELECT *, power / sum(power) OVER (PARTITION BY asset) AS p, count(*) OVER (PARTITION BY asset) AS n, median(power) OVER (PARTITION BY asset ORDER BY k ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS ring FROM we),
    b AS (SELECT asset, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln(max(n)) AS entropy, first(k ORDER BY power DESC, k) AS k, first(power / ring ORDER BY power DESC, k) AS prominence FROM r GROUP BY 1)
    SELECT asset, round(entropy, 6) AS entropy, round(4.0 * {SEGMENT} / k, 6) AS period, round(prominence, 6) AS prominence FROM b""")
def spectrum_summary(spark, sf_dir):
    return rounded(spectral.summary(spectral.welch(transformed(spark, sf_dir)), SEGMENT))


@query("h5_coherence", f"""WITH {WK}{DET}{FOU}, c AS (SELECT x.asset AS a, y.asset AS b, x.k, count(*) AS segments, avg(x.re * y.re + x.im * y.im) AS r, avg(x.im * y.re - x.re * y.im) AS i, avg(x.re * x.re + x.im * x.im) AS pa, avg(y.re * y.re + y.im * y.im) AS pb FROM fo x JOIN fo y ON x.seg = y.seg AND x.k = y.k AND x.asset < y.asset GROUP BY 1, 2, 3)
    SELECT a, b, k, segments, round((r * r + i * i) / (pa * pb), 6) AS coherence, round(atan2(i, r), 5) AS phase FROM c""")
def coherence(spark, sf_dir):
    return rounded(spectral.coherence(transformed(spark, sf_dir)), phase=5)


SIZES, _box = [], 8.0
while _box < 1e6:
    SIZES.append(int(_box))
    _box *= 1.35
DFA = f"""{RET}, h0 AS (SELECT asset, row_number() OVER (PARTITION BY asset ORDER BY ts) - 1 AS i, ts, r - avg(r) OVER (PARTITION BY asset) AS c, count(*) OVER (PARTITION BY asset) AS n FROM ret), h1 AS (SELECT asset, i, n, sum(c) OVER (PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING) AS y FROM h0),
    h2 AS (SELECT asset, box, i // box AS k, regr_syy(y, i) AS syy, regr_sxy(y, i) AS sxy, regr_sxx(y, i) AS sxx FROM h1 JOIN (SELECT unnest({SIZES}) AS box) z ON box <= n / 4 WHERE (i // box + 1) * box <= n GROUP BY 1, 2, 3),
    h3 AS (SELECT asset, box, sqrt(sum(greatest(syy - sxy * sxy / sxx, 0)) / (count(*) * box)) AS f FROM h2 GROUP BY 1, 2), h4 AS (SELECT asset, least(1.2, greatest(0, regr_slope(ln(f), ln(box)))) AS hurst, regr_r2(ln(f), ln(box)) AS r2 FROM h3 WHERE f > 0 GROUP BY 1 HAVING count(*) >= 4),
    hu AS (SELECT asset, hurst, r2, CASE WHEN hurst > 0.55 THEN 'trending' WHEN hurst < 0.45 THEN 'reverting' ELSE 'random' END AS label, least(1, abs(hurst - 0.5) / 0.25) * r2 AS confidence FROM h4)"""


@query("h2_band_pass", f"""WITH RECURSIVE {WK}, l AS (SELECT asset, ts, ln(close) AS y, row_number() OVER (PARTITION BY asset ORDER BY ts) AS i, count(*) OVER (PARTITION BY asset) AS n FROM bars WHERE close > 0),
    g AS (SELECT asset, i, ts, n, y AS fast, y AS slow FROM l WHERE i = 1 UNION ALL SELECT l.asset, l.i, l.ts, l.n, fast + (2 / 3.5) * (y - fast), slow + (2 / 145.0) * (y - slow) FROM g JOIN l ON l.asset = g.asset AND l.i = g.i + 1)
    SELECT asset, ts, round(fast - slow, 6) AS band FROM g WHERE n >= 8 AND i > CASE WHEN n - least(n // 4, 240) > 32 THEN least(n // 4, 240) ELSE 0 END""")
def band_pass(spark, sf_dir):
    return rounded(spectral.band_pass(t.bars(spark, sf_dir, "week")))


@query("h6_cycle_stability", f"""WITH {D}{DET}{FOU.replace('range(12, 129)', 'range(5, 103)')}, w0 AS (SELECT asset, k, re, im, unnest(range(greatest(0, seg - 6), seg + 1)) AS w FROM fo), wp AS (SELECT asset, w, k, avg(re * re + im * im) AS power FROM w0 GROUP BY 1, 2, 3 HAVING count(*) = 7),
    wr AS (SELECT *, median(power) OVER (PARTITION BY asset, w ORDER BY k ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS ring FROM wp), pk AS (SELECT asset, w, first(4.0 * {SEGMENT} / k ORDER BY power DESC, k) AS period, first(power / ring ORDER BY power DESC, k) AS prominence FROM wr GROUP BY 1, 2),
    pv AS (SELECT *, CASE WHEN prominence >= 4 THEN period END AS p, median(CASE WHEN prominence >= 4 THEN period END) OVER (PARTITION BY asset) AS m, median(prominence) OVER (PARTITION BY asset) AS pm FROM pk)
    SELECT asset, count(*) AS windows, round(avg(CASE WHEN abs(p - m) / m <= 0.2 THEN 1.0 ELSE 0 END), 6) AS stability, round(coalesce(any_value(m), 0), 6) AS period, round(coalesce(avg(abs(p - m)), 0), 6) AS deviation, round(any_value(pm), 6) AS prominence FROM pv GROUP BY 1""")
def cycle_stability(spark, sf_dir):
    return rounded(spectral.cycle_stability(spectral.fourier(spectral.detrended(t.bars(spark, sf_dir)), range(5, 103), SEGMENT), SEGMENT))


def cycles(spark, sf_dir):
    return spectral.instant_cycle(spectral.band_pass(t.bars(spark, sf_dir)))


@query("h7_instant_cycle")
def instant_cycle(spark, sf_dir):
    return rounded(cycles(spark, sf_dir))


@query("h8_cycle_projection")
def cycle_projection(spark, sf_dir):
    return rounded(spectral.cycle_projection(cycles(spark, sf_dir), 20))


def patterns(spark, sf_dir):
    """Peaks a fifth above their ring, whatever the stability, as prices without cycles have nothing stronger."""
    series = spectral.detrended(t.bars(spark, sf_dir))
    return spectral.frequency_patterns(series, spectral.fourier(series, range(5, 103), SEGMENT), SEGMENT, least_prominence=1.2, least_stability=0.0)


@query("h13_frequency_patterns")
def frequency_patterns(spark, sf_dir):
    return rounded(patterns(spark, sf_dir))


@query("h15_pattern_matches")
def pattern_matches(spark, sf_dir):
    return rounded(spectral.match_patterns(patterns(spark, sf_dir)))


@query("h16_recurring_pairs")
def recurring_pairs(spark, sf_dir):
    return rounded(spectral.recurring_pairs(spectral.match_patterns(patterns(spark, sf_dir)), 2))


PROBES = (8, 13, 21, 34, 55, 89)


@query("h14_phase_projection", f"""WITH {D}{DET}, pj AS (SELECT asset, p AS period, count(*) AS n, sum(x * cos(2 * pi() / p * (i - m))) AS c, sum(x * sin(2 * pi() / p * (i - m))) AS s FROM (SELECT *, max(i) OVER (PARTITION BY asset) AS m FROM de) CROSS JOIN (SELECT unnest({list(PROBES)}) AS p) GROUP BY 1, 2)
    SELECT asset, period, round(CASE WHEN degrees(atan2(-s, c)) < 0 THEN degrees(atan2(-s, c)) + 360 ELSE degrees(atan2(-s, c)) END, 4) AS phase, round(2 * sqrt(c * c + s * s) / n, 6) AS amplitude FROM pj""")
def phase_projection(spark, sf_dir):
    return rounded(spectral.phase_projection(spectral.detrended(t.bars(spark, sf_dir)), PROBES), phase=4)


@query("h10_regime_prior", f"""WITH {D}{DFA}, k AS (SELECT *, 1 + 0.5 * least(1, greatest(0, confidence)) AS k FROM hu), w AS (SELECT asset, confidence, unnest([struct_pack(model := 'naive', w := 1.0::DOUBLE), struct_pack(model := 'drift', w := CASE label WHEN 'trending' THEN k ELSE 1 END), struct_pack(model := 'momentum', w := CASE label WHEN 'trending' THEN k WHEN 'reverting' THEN 1 / k ELSE 1 END),
      struct_pack(model := 'meanrev', w := CASE label WHEN 'trending' THEN 1 / k WHEN 'reverting' THEN k ELSE 1 END), struct_pack(model := 'leadlag', w := 1.0::DOUBLE)]) AS m FROM k)
    SELECT asset, m.model AS model, round(m.w / CASE WHEN confidence > 0 THEN sum(m.w) OVER (PARTITION BY asset) ELSE 1 END, 5) AS weight FROM w""")
def regime_prior(spark, sf_dir):
    return rounded(spectral.regime_prior(spectral.hurst(log_returns(t.bars(spark, sf_dir)).select("asset", "ts", "r"))), 5)


@query("h9_hurst", f"WITH {D}{DFA} SELECT asset, round(hurst, 6) AS hurst, round(r2, 6) AS r2, label, round(confidence, 6) AS confidence FROM hu")
def hurst(spark, sf_dir):
    return rounded(spectral.hurst(log_returns(t.bars(spark, sf_dir)).select("asset", "ts", "r")))


@query("h11_ssa_forecast")
def ssa_forecast(spark, sf_dir):
    return rounded(spectral.ssa(t.bars(spark, sf_dir)))


STATE = f"""{RET}, fl2 AS (SELECT b.asset, b.ts, cls, r, CASE WHEN b.volume > 0 THEN CASE WHEN cls = 2 THEN b.volume ELSE b.close * b.volume END END AS gross, CASE WHEN lag(b.close, 5) OVER (PARTITION BY b.asset ORDER BY b.ts) > 0 THEN ln(b.close / lag(b.close, 5) OVER (PARTITION BY b.asset ORDER BY b.ts)) END AS r5 FROM bars b JOIN ret USING (asset, ts) JOIN assets USING (asset))"""


@query("j1_market_state", f"WITH {D}, {A}{STATE} SELECT ts, round(avg(r), 6) AS mean_r1, round(avg(r5), 6) AS mean_r5, round(coalesce(stddev_samp(r), 0), 6) AS dispersion, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END), 6) AS breadth, round(count(*) / (SELECT count(*) FROM assets), 6) AS coverage FROM fl2 GROUP BY 1")
def market_state(spark, sf_dir):
    rows = log_returns(t.bars(spark, sf_dir)).withColumn("r5", F.ln(F.col("close") / F.lag("close", 5).over(own())))
    n = t.assets(spark, sf_dir).agg(F.count(F.lit(1)).alias("_n"))
    own_ = rows.groupBy("ts").agg(F.avg("r").alias("mean_r1"), F.avg("r5").alias("mean_r5"), F.coalesce(F.stddev_samp("r"), F.lit(0.0)).alias("dispersion"), F.avg((F.col("r") > 0).cast("double")).alias("breadth"), F.count(F.lit(1)).alias("_c"))
    return rounded(own_.join(F.broadcast(n)).withColumn("coverage", F.col("_c") / F.col("_n")).drop("_c", "_n"))


@query("j4_forward_targets", f"WITH {D} SELECT asset, ts, {', '.join(f'round(ln(lead(close, {h}) OVER (PARTITION BY asset ORDER BY ts) / close), 6) AS y_h{h}' for h in (1, 5, 20))} FROM bars")
def forward_targets(spark, sf_dir):
    return rounded(t.bars(spark, sf_dir).select("asset", "ts", *[F.ln(F.lead("close", h).over(own()) / F.col("close")).alias(f"y_h{h}") for h in (1, 5, 20)]))


@query("j5_chronological_split", f"WITH {D}, d AS (SELECT ts, (row_number() OVER (ORDER BY ts) - 1) / count(*) OVER () AS p FROM (SELECT DISTINCT ts FROM bars)) SELECT CASE WHEN p < 0.6 THEN 'train' WHEN p < 0.8 THEN 'valid' ELSE 'test' END AS part, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM bars JOIN d USING (ts) GROUP BY 1")
def chronological_split(spark, sf_dir):
    bars = t.bars(spark, sf_dir)
    days = bars.select("ts").distinct().withColumn("_p", (F.row_number().over(Window.orderBy("ts")) - 1) / F.count(F.lit(1)).over(Window.partitionBy()))
    part = F.when(F.col("_p") < 0.6, "train").when(F.col("_p") < 0.8, "valid").otherwise("test")
    return bars.join(days, "ts").groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("j7_sequence_windows", f"""WITH {WK}{RET}, y AS (SELECT asset, ts, lead(r, 1) OVER (PARTITION BY asset ORDER BY ts) AS target FROM ret), v AS (SELECT asset, ts, list(r) OVER w AS v FROM ret WINDOW w AS (PARTITION BY asset ORDER BY ts ROWS 23 PRECEDING))
    SELECT asset, ts, place, round(x, 6) AS x, round(target, 6) AS target FROM (SELECT asset, ts, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM v WHERE len(v) = 24) JOIN y USING (asset, ts) WHERE target IS NOT NULL AND isfinite(target)""")
def sequence_windows(spark, sf_dir):
    """The last 24 returns before each target, the return after; only whole windows with a finite target."""
    rows = log_returns(t.bars(spark, sf_dir, "week")).withColumn("_s", F.collect_list("r").over(own().rowsBetween(-23, 0))).withColumn("target", F.lead("r").over(own()))
    rows = rows.where((F.size("_s") == 24) & F.col("target").isNotNull() & ~F.isnan("target"))
    return rounded(rows.select("asset", "ts", F.posexplode("_s").alias("place", "x"), "target").withColumn("place", F.col("place") + 1))
