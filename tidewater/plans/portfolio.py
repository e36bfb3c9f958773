"""Long-term, intraday, portfolio and candidates (M of the inventory)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.functions.series import own
from tidewater.operators import events as event_ops, portfolio as ops
from tidewater.operators.bars import log_returns
from tidewater.sources import tables as t

from . import forecast as fc
from . import pairs as pr
from .alignment import D, WK
from .curves import EV
from .registry import query, rounded

A = t.ASSET_SQL
LR = ", lr AS (SELECT asset, ts, close, ln(close / lag(close) OVER (PARTITION BY asset ORDER BY ts)) AS r FROM bars)"


def returns(spark, sf_dir, unit="day"):
    return t.bars(spark, sf_dir, unit).withColumn("r", F.ln(F.col("close") / F.lag("close").over(own())))


@query("m1_annual_return", f"""WITH {D}{LR}, s AS (SELECT asset, count(r) AS n, avg(r) AS m, stddev_samp(r) AS s, count(r) / (date_diff('day', min(ts), max(ts)) / 365.25) AS y FROM lr GROUP BY 1)
    SELECT asset, n, round(exp(m * y) - 1, 5) AS annual_return, round(s * sqrt(y), 5) AS annual_volatility FROM s""")
def annual_return(spark, sf_dir):
    return rounded(ops.annual(returns(spark, sf_dir)), 5)


@query("m2_max_drawdown", f"WITH {D}, d AS (SELECT asset, 1 - close / max(close) OVER (PARTITION BY asset ORDER BY ts) AS d FROM bars) SELECT asset, round(max(d), 6) AS max_drawdown FROM d GROUP BY 1")
def max_drawdown(spark, sf_dir):
    return rounded(ops.max_drawdown(t.bars(spark, sf_dir)))


@query("m3_rolling_year", f"""WITH {WK}, r AS (SELECT asset, close / lag(close, 52) OVER (PARTITION BY asset ORDER BY ts) - 1 AS r FROM bars)
    SELECT asset, count(*) AS windows, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END), 6) AS share_positive, round(min(r), 6) AS worst, round(max(r), 6) AS best FROM r WHERE r IS NOT NULL GROUP BY 1""")
def rolling_year(spark, sf_dir):
    return rounded(ops.rolling_windows(t.bars(spark, sf_dir, "week"), 52))


@query("m4_series_selection", f"WITH {D} SELECT asset, count(*) AS days FROM bars WHERE ts >= '1996-01-01' GROUP BY 1 HAVING count(*) >= 1200")
def series_selection(spark, sf_dir):
    return t.bars(spark, sf_dir).where("ts >= '1996-01-01'").groupBy("asset").agg(F.count(F.lit(1)).alias("days")).where("days >= 1200")


@query("m5_fixed_baskets", f"""WITH {WK}{LR}, {A}, b AS (SELECT asset, region AS basket FROM assets), z AS (SELECT basket, count(*) AS size FROM b GROUP BY 1),
    g AS (SELECT b.basket, ts, avg(r) AS r, count(*) AS n FROM lr JOIN b USING (asset) WHERE r IS NOT NULL GROUP BY 1, 2), q AS (SELECT g.basket, ts, r FROM g JOIN z ON z.basket = g.basket AND z.size = g.n)
    SELECT basket, count(*) AS n, round(avg(r), 6) AS mean_r, round(stddev_samp(r), 6) AS sd_r FROM q GROUP BY 1""")
def fixed_baskets(spark, sf_dir):
    baskets = t.assets(spark, sf_dir).select("asset", F.col("region").alias("basket"))
    own_ = ops.basket_returns(returns(spark, sf_dir, "week").where("r IS NOT NULL"), baskets)
    return rounded(own_.groupBy("basket").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean_r"), F.stddev_samp("r").alias("sd_r")))


#: Where the half that a basket is judged on begins.
HALF = "TIMESTAMP '1998-06-01 00:00:00'"


@query("m5_basket_holdout", f"""WITH {WK}{LR}, {A}, bk AS (SELECT asset, region AS basket FROM assets), z AS (SELECT basket, count(*) AS size FROM bk GROUP BY 1), mr AS (SELECT bk.basket, lr.asset, ts, r FROM lr JOIN bk USING (asset) WHERE r IS NOT NULL),
    cm AS (SELECT basket, ts FROM mr JOIN z USING (basket) GROUP BY 1, 2 HAVING count(*) = any_value(size)), mm AS (SELECT mr.*, ts >= {HALF} AS late FROM mr JOIN cm USING (basket, ts)), bq AS (SELECT basket, ts, late, avg(r) AS r FROM mm GROUP BY 1, 2, 3),
    cv AS (SELECT basket, ts, r, exp(sum(r) OVER (PARTITION BY basket ORDER BY ts)) AS v, sum(r) OVER (PARTITION BY basket ORDER BY ts ROWS 51 PRECEDING) AS y, count(*) OVER (PARTITION BY basket ORDER BY ts ROWS 51 PRECEDING) AS k FROM bq WHERE late),
    dd AS (SELECT *, 1 - v / greatest(1, max(v) OVER (PARTITION BY basket ORDER BY ts)) AS d FROM cv),
    mt AS (SELECT basket, count(*) AS n, count(*) / (date_diff('day', min(ts), max(ts)) / 365.25) AS year, avg(r) AS m, stddev_samp(r) AS s, max(d) AS drawdown, avg(CASE WHEN k = 52 THEN CASE WHEN y > 0 THEN 1.0 ELSE 0 END END) AS positive FROM dd GROUP BY 1),
    cr AS (SELECT x.basket, x.late, corr(x.r, y.r) AS c FROM mm x JOIN mm y ON x.basket = y.basket AND x.ts = y.ts AND x.asset < y.asset GROUP BY x.basket, x.late, x.asset, y.asset), cs AS (SELECT basket, avg(c) FILTER (late) AS mean_r, max(c) FILTER (late) AS max_r, max(c) FILTER (NOT late) AS chosen_r FROM cr GROUP BY 1)
    SELECT basket, n, round(exp(m * year) - 1, 5) AS annual_return, round(s * sqrt(year), 5) AS annual_volatility, round(drawdown, 6) AS max_drawdown, round(positive, 6) AS positive_years, round(mean_r, 6) AS mean_correlation, round(max_r, 6) AS max_correlation, round(max_r - chosen_r, 6) AS drift FROM mt JOIN cs USING (basket)""")
def basket_holdout(spark, sf_dir):
    baskets = t.assets(spark, sf_dir).select("asset", F.col("region").alias("basket"))
    return rounded(ops.basket_holdout(returns(spark, sf_dir, "week").where("r IS NOT NULL").select("asset", "ts", "r"), baskets, F.expr(HALF), 52), annual_return=5, annual_volatility=5)


@query("m6_greedy_baskets")
def greedy_baskets(spark, sf_dir):
    """Chosen from the first 60 % of the time, which ends in June 1996."""
    return rounded(ops.greedy_baskets(returns(spark, sf_dir, "week").where("ts < TIMESTAMP '1996-06-01'").select("asset", "ts", "r")))


@query("m7_intraday_mobility", f"""WITH {t.HOURLY_SQL}, m AS (SELECT asset, abs(ln(close / lag(close) OVER (PARTITION BY asset ORDER BY ts))) AS m FROM bars)
    SELECT asset, round(avg(m), 6) AS mean_move, round(median(m), 6) AS median_move, round(avg(CASE WHEN m > 0.003 THEN 1.0 ELSE 0 END), 6) AS above_one, round(avg(CASE WHEN m > 0.006 THEN 1.0 ELSE 0 END), 6) AS above_two FROM m WHERE m IS NOT NULL GROUP BY 1""")
def intraday_mobility(spark, sf_dir):
    return rounded(ops.mobility(t.hourly_bars(spark, sf_dir), ["asset"]))


@query("m8_class_freshness", f"WITH {D}, {A} SELECT cls, max(ts) AS newest, date_diff('day', max(ts), (SELECT max(ts) FROM bars)) AS age_days FROM bars JOIN assets USING (asset) GROUP BY 1")
def class_freshness(spark, sf_dir):
    own_ = t.bars(spark, sf_dir).join(t.assets(spark, sf_dir).select("asset", "cls"), "asset").groupBy("cls").agg(F.max("ts").alias("newest"))
    return own_.join(F.broadcast(own_.agg(F.max("newest").alias("_now")))).select("cls", "newest", F.datediff("_now", "newest").cast("long").alias("age_days"))


@query("m9_hourly_movers", f"""WITH {t.HOURLY_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts DESC) AS n FROM bars),
    s AS (SELECT asset, max(CASE WHEN n = 1 THEN close END) / max(CASE WHEN n = 2 THEN close END) - 1 AS move, max(CASE WHEN n = 1 THEN close END) / max(CASE WHEN n = 6 THEN close END) - 1 AS move5, max(high) / min(low) - 1 AS "range" FROM n WHERE n <= 6 GROUP BY 1)
    SELECT asset, round(move, 6) AS move, round(move5, 6) AS move5, round("range", 6) AS "range" FROM s ORDER BY round(abs(move), 9) DESC, asset LIMIT 20""")
def hourly_movers(spark, sf_dir):
    return rounded(ops.movers(t.hourly_bars(spark, sf_dir), 20))


EXP = "(2 * hit_rate - 1) * mean_move - 0.003"


@query("m10_intraday_expectancy", f"""WITH {fc.WK}{fc.FC}{fc.CM}{fc.SC}, h AS (SELECT asset, avg(CASE WHEN hit THEN 1.0 ELSE 0 END) AS hit_rate, avg(abs(actual_return)) AS mean_move FROM sc WHERE h = 1 GROUP BY 1)
    SELECT asset, round(hit_rate, 6) AS hit_rate, round(mean_move, 6) AS mean_move, round({EXP}, 6) AS expectancy, round((0.003 / mean_move + 1) / 2, 6) AS required_hit FROM h""")
def intraday_expectancy(spark, sf_dir):
    own_ = fc.scores(spark, sf_dir).where("h = 1").groupBy("asset").agg(F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.avg(F.abs("actual_return")).alias("mean_move"))
    return rounded(own_.withColumn("expectancy", ops.expectancy(F.col("hit_rate"), F.col("mean_move"))).withColumn("required_hit", ops.required_hit(F.col("mean_move"))))


CALLS = (0.5, 0.55, 0.6)


@query("m11_cost_model", f"""WITH {t.HOURLY_SQL}, m AS (SELECT asset, avg(abs(ln(close / lag))) AS m FROM (SELECT asset, close, lag(close) OVER (PARTITION BY asset ORDER BY ts) AS lag FROM bars) WHERE lag IS NOT NULL GROUP BY 1)
    SELECT asset, p AS hit_rate, round(m, 6) AS mean_move, round((2 * p - 1) * m - 0.003, 6) AS expectancy, round(m - 0.003, 6) AS after_cost, round(CASE WHEN m <= 0 THEN 1 ELSE (0.003 / m + 1) / 2 END, 6) AS required_hit FROM m CROSS JOIN (SELECT unnest({list(CALLS)}::DOUBLE[]) AS p)""")
def cost_model(spark, sf_dir):
    """What calls of several hit rates are worth on each asset's mean hourly move after a round trip."""
    moves_ = ops.mobility(t.hourly_bars(spark, sf_dir), ["asset"]).select("asset", "mean_move", F.explode(F.array(*map(F.lit, CALLS))).alias("hit_rate"))
    m = F.col("mean_move")
    return rounded(moves_.select("asset", "hit_rate", "mean_move", ops.expectancy(F.col("hit_rate"), m).alias("expectancy"), ops.after_cost(m).alias("after_cost"), ops.required_hit(m).alias("required_hit")))


def bookings(spark, sf_dir):
    """Every order line books shares of its brand into a depot, the order's priority; orders of status F sell."""
    lines = t.ticks(spark, sf_dir).select("asset", "price", "volume", "ord", F.col("ord.l_orderkey").alias("o_orderkey"))
    orders = t.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("depot"), F.col("o_orderdate").alias("booked"), "o_orderstatus")
    sign = F.when(F.col("o_orderstatus") == "F", -1).otherwise(1)
    return lines.join(orders, "o_orderkey").select("depot", "asset", "booked", "ord", (F.col("volume") * sign).alias("shares"), F.round(F.col("price") * F.col("volume"), 2).cast("decimal(18,2)").alias("amount"), F.round(F.col("price") * F.col("volume") * 0.001, 2).cast("decimal(18,2)").alias("fee"))


BOOK = f"""{t.TICK_SQL}, bk AS (SELECT o_orderpriority AS depot, asset, CAST(o_orderdate AS TIMESTAMP) AS booked, CASE WHEN o_orderstatus = 'F' THEN -volume ELSE volume END AS shares, CAST(round(price * volume, 2) AS DECIMAL(18,2)) AS amount FROM tick JOIN orders ON l_orderkey = o_orderkey),
    mv AS (SELECT o_orderpriority AS depot, CAST(o_orderdate AS TIMESTAMP) AS booked, o_orderkey AS ord, CASE o_orderstatus WHEN 'F' THEN 'withdrawal' WHEN 'O' THEN 'deposit' ELSE 'fee' END AS reason, CASE o_orderstatus WHEN 'F' THEN -1 WHEN 'O' THEN 1 ELSE -0.01 END * CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders)"""


def moves(spark, sf_dir):
    """Orders as cash moves: deposits (O), withdrawals (F), fees of a hundredth (P)."""
    s, amount = F.col("o_orderstatus"), F.col("o_totalprice").cast("decimal(18,2)")
    return t.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("depot"), F.col("o_orderdate").alias("booked"), F.col("o_orderkey").alias("ord"), F.when(s == "F", "withdrawal").when(s == "O", "deposit").otherwise("fee").alias("reason"),
        (F.when(s == "F", F.lit(-1).cast("decimal(3,2)")).when(s == "O", F.lit(1).cast("decimal(3,2)")).otherwise(F.lit("-0.01").cast("decimal(3,2)")) * amount).cast("decimal(20,4)").alias("amount"),
    )


@query("m12_positions", f"""WITH {BOOK}, {t.bars_sql()}, p AS (SELECT asset, arg_max(close, ts) AS price FROM bars GROUP BY 1)
    SELECT depot, asset, sum(shares) AS shares, CAST(sum(CASE WHEN shares > 0 THEN amount ELSE 0 END) AS DOUBLE) AS paid_in, CAST(sum(CASE WHEN shares < 0 THEN amount ELSE 0 END) AS DOUBLE) AS taken_out, min(booked) AS first_booked, round(sum(shares) * any_value(price), 0) AS value FROM bk JOIN p USING (asset) GROUP BY 1, 2""")
def positions(spark, sf_dir):
    prices = t.bars(spark, sf_dir).groupBy("asset").agg(F.max_by("close", "ts").alias("close"))
    own_ = ops.positions(bookings(spark, sf_dir), prices)
    return own_.select("depot", "asset", "shares", F.col("paid_in").cast("double").alias("paid_in"), F.col("taken_out").cast("double").alias("taken_out"), "first_booked", F.round("value", 0).alias("value"))


@query("m13_cash_accounts", f"WITH {BOOK} SELECT depot, CAST(sum(amount) AS DOUBLE) AS balance, CAST(sum(CASE WHEN reason = 'deposit' THEN amount ELSE 0 END) AS DOUBLE) AS deposits, CAST(sum(CASE WHEN reason = 'withdrawal' THEN amount ELSE 0 END) AS DOUBLE) AS withdrawals, CAST(sum(CASE WHEN reason = 'fee' THEN amount ELSE 0 END) AS DOUBLE) AS fees FROM mv GROUP BY 1")
def cash_accounts(spark, sf_dir):
    own_ = ops.cash_accounts(moves(spark, sf_dir))
    return own_.select("depot", *[F.col(c).cast("double").alias(c) for c in ("balance", "deposits", "withdrawals", "fees")])


@query("m14_ledger_journal", f"WITH {BOOK} SELECT depot, booked, ord, reason, CAST(amount AS DOUBLE) AS amount, CAST(sum(amount) OVER (PARTITION BY depot ORDER BY booked, ord ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS balance FROM mv")
def ledger_journal(spark, sf_dir):
    own_ = ops.journal(moves(spark, sf_dir))
    return own_.select("depot", "booked", "ord", "reason", F.col("amount").cast("double").alias("amount"), F.col("balance").cast("double").alias("balance"))


WEALTH = f"""WITH {BOOK}, {t.bars_sql('week')}, cal AS (SELECT DISTINCT ts FROM bars), pa AS (SELECT DISTINCT depot, asset FROM bk),
    gr AS (SELECT depot, asset, ts, (SELECT coalesce(sum(shares), 0) FROM bk WHERE bk.depot = pa.depot AND bk.asset = pa.asset AND bk.booked <= cal.ts) AS sh FROM pa CROSS JOIN cal),
    gp AS (SELECT g.depot, g.asset, g.ts, g.sh, b.close FROM gr g ASOF LEFT JOIN bars b ON b.asset = g.asset AND b.ts <= g.ts),
    st AS (SELECT depot, ts, sum(coalesce(sh * close, 0)) AS positions FROM gp GROUP BY 1, 2),
    we AS (SELECT st.*, (SELECT coalesce(CAST(sum(amount) AS DOUBLE), 0) FROM mv WHERE mv.depot = st.depot AND mv.booked <= st.ts) AS cash FROM st)"""


@query("m15_wealth_curve", f"{WEALTH} SELECT depot, ts, round(positions, 0) AS positions, round(cash, 0) AS cash, round(positions + cash, 0) AS wealth FROM we")
def wealth_curve(spark, sf_dir):
    own_ = ops.wealth_curve(bookings(spark, sf_dir), moves(spark, sf_dir), t.bars(spark, sf_dir, "week"))
    return rounded(own_, positions=0, cash=0, wealth=0)


@query("m17_strategy_curves", f"{WEALTH}, wx AS (SELECT depot, ts, positions + cash AS w FROM we) SELECT depot, ts, round(100 * w / first_value(CASE WHEN w > 0 THEN w END IGNORE NULLS) OVER (PARTITION BY depot ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 3) AS index FROM wx")
def strategy_curves(spark, sf_dir):
    own_ = ops.wealth_curve(bookings(spark, sf_dir), moves(spark, sf_dir), t.bars(spark, sf_dir, "week"))
    return rounded(ops.indexed(own_, "depot", "wealth").select("depot", "ts", "index"), 3)


SHR = f"""WITH {fc.WK}{fc.FC}{fc.CM}{fc.SC}, c AS (SELECT asset, count(*) AS n, count(*) FILTER (hit) AS hits FROM sc WHERE h = 5 GROUP BY 1), m AS (SELECT sum(hits) / sum(n) AS m, var_samp(hits / n) AS v, count(*) AS a FROM c),
    z AS (SELECT avg(m * (1 - m) / n) AS noise FROM c, m), y AS (SELECT c.*, m.*, v - noise AS tr FROM c, m, z),
    sh AS (SELECT asset, n, hits / n AS hit_rate, CASE WHEN a < 10 THEN hits / n WHEN tr <= 0 THEN m ELSE (m * m * (1 - m) / tr + hits) / (m * (1 - m) / tr + n) END AS shrunk FROM y)"""


def hits(spark, sf_dir):
    return fc.scores(spark, sf_dir).where("h = 5").groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"))


@query("m19_shrinkage", f"{SHR} SELECT asset, n, round(hit_rate, 6) AS hit_rate, round(shrunk, 6) AS shrunk FROM sh")
def shrinkage(spark, sf_dir):
    return rounded(ops.shrunken(hits(spark, sf_dir)))


CAND = SHR + """, la AS (SELECT asset, arg_max(combined, ts) AS f5 FROM cm WHERE h = 5 GROUP BY 1), l1 AS (SELECT asset, arg_max(combined, ts) AS f1 FROM cm WHERE h = 1 GROUP BY 1), mm AS (SELECT asset, avg(abs(actual_return)) AS mean_move FROM sc WHERE h = 5 GROUP BY 1),
    ca AS (SELECT asset, f1, f5, shrunk, mean_move, least(1, greatest(0, (shrunk - 0.5) / 0.1)) AS merit FROM la JOIN l1 USING (asset) JOIN mm USING (asset) JOIN sh USING (asset)),
    cs AS (SELECT *, CASE WHEN merit > 0 THEN (f1 * merit + f5 * merit * 0.5) / (merit * 1.5) ELSE (f1 + f5) / 2 END AS score, (2 * shrunk - 1) * mean_move - 0.003 AS expectancy FROM ca)"""


def candidates(spark, sf_dir):
    combined = fc.ops.combine(fc.made(spark, sf_dir))
    latest = combined.groupBy("asset").agg(*[F.max_by(F.when(F.col("h") == h, F.col("combined")), F.when(F.col("h") == h, F.col("ts"))).alias(f"f{h}") for h in (1, 5)])
    move = fc.ops.scored(combined).where("h = 5").groupBy("asset").agg(F.avg(F.abs("actual_return")).alias("mean_move"))
    rows = latest.join(move, "asset").join(ops.shrunken(hits(spark, sf_dir)).select("asset", "shrunk"), "asset").withColumn("merit", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("shrunk") - 0.5) / 0.1)))
    score = F.when(F.col("merit") > 0, F.try_divide(F.col("f1") * F.col("merit") + F.col("f5") * F.col("merit") * 0.5, F.col("merit") * 1.5)).otherwise((F.col("f1") + F.col("f5")) / 2)
    return rows.withColumn("score", score).withColumn("expectancy", ops.expectancy(F.col("shrunk"), F.col("mean_move")))


@query("m18_candidate_ranking", f"{CAND} SELECT asset, round(score, 6) AS score, round(shrunk, 6) AS shrunk, round(expectancy, 6) AS expectancy, row_number() OVER (ORDER BY round(score, 9) DESC, asset) AS place FROM cs")
def candidate_ranking(spark, sf_dir):
    own_ = candidates(spark, sf_dir)
    return rounded(own_.select("asset", "score", "shrunk", "expectancy", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "asset")).alias("place")))


@query("m20_target_baskets", f"""{CAND}, st AS (SELECT 'strict' AS strategy, asset, score FROM cs WHERE expectancy > 0 AND score > 0 UNION ALL SELECT 'active', asset, score FROM cs WHERE score > 0 UNION ALL SELECT 'inverse', asset, -score FROM cs WHERE score < 0)
    SELECT strategy, asset, place FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY round(score, 9) DESC, asset) AS place FROM st) WHERE place <= 5""")
def target_baskets(spark, sf_dir):
    own_ = candidates(spark, sf_dir)
    parts = F.array_compact(F.array(F.when((F.col("expectancy") > 0) & (F.col("score") > 0), F.struct(F.lit("strict").alias("strategy"), F.col("score").alias("s"))), F.when(F.col("score") > 0, F.struct(F.lit("active").alias("strategy"), F.col("score").alias("s"))), F.when(F.col("score") < 0, F.struct(F.lit("inverse").alias("strategy"), (-F.col("score")).alias("s")))))
    rows = own_.withColumn("_p", F.explode(parts)).select("asset", "_p.strategy", "_p.s")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("strategy").orderBy(F.desc(F.round("s", 9)), "asset"))).where("place <= 5").select("strategy", "asset", "place")


@query("m21_decorrelated_top", f"""{CAND.replace("WITH ", "WITH RECURSIVE ", 1)}{pr.CLOSES}, rt AS (SELECT a, b, row_number() OVER w AS i, CASE WHEN ca > 0 AND lag(ca) OVER w > 0 THEN ln(ca / lag(ca) OVER w) ELSE 0 END AS ra, CASE WHEN cb > 0 AND lag(cb) OVER w > 0 THEN ln(cb / lag(cb) OVER w) ELSE 0 END AS rb FROM cl WINDOW w AS (PARTITION BY a, b ORDER BY ts)),
    cp AS (SELECT a, b FROM rt WHERE i > 1 GROUP BY 1, 2 HAVING count(*) + 1 >= 60 AND abs(corr(ra, rb)) > 0.05), ne AS (SELECT asset, list(o) AS near FROM (SELECT a AS asset, b AS o FROM cp UNION ALL SELECT b, a FROM cp) GROUP BY 1),
    tp AS MATERIALIZED (SELECT r.*, coalesce(near, []::VARCHAR[]) AS near FROM (SELECT asset, row_number() OVER (ORDER BY score DESC, asset) AS i FROM cs) r LEFT JOIN ne USING (asset) WHERE i <= 20),
    wk AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS used UNION ALL SELECT tp.i, CASE WHEN list_has_any(used, near) THEN used ELSE list_append(used, tp.asset) END FROM wk JOIN tp ON tp.i = wk.i + 1)
    SELECT CAST(unnest(range(1, len(used) + 1)) AS INT) AS place, unnest(used) AS asset FROM (SELECT used FROM wk ORDER BY i DESC LIMIT 1)""")
def decorrelated_top(spark, sf_dir):
    pairs = pr.stats(spark, sf_dir).select("a", "b", F.col("corr0").alias("r"))
    return ops.decorrelated(candidates(spark, sf_dir).select("asset", "score"), pairs, 20, 0.05)


@query("m22_listings_cohort", f"""WITH {D}, l AS (SELECT p_brand AS asset, min(p_name) AS label, DATE '1995-01-01' + CAST(min(p_partkey) * 30 AS INT) AS expected FROM part GROUP BY 1), f AS (SELECT asset, min(ts) AS first_ts, arg_min(close, ts) AS first_close FROM bars WHERE close > 0 GROUP BY 1)
    SELECT l.asset, CAST(expected AS TIMESTAMP) AS expected, first_ts, first_close, date_diff('day', expected, CAST(first_ts AS DATE)) AS lead_days, CASE WHEN first_ts IS NULL THEN 'failed' WHEN CAST(first_ts AS DATE) <= expected THEN 'early' ELSE 'late' END AS status FROM l LEFT JOIN f USING (asset)""")
def listings_cohort(spark, sf_dir):
    listed = t.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("asset")).agg(F.expr("date_add(DATE '1995-01-01', CAST(min(p_partkey) * 30 AS INT))").alias("expected"))
    first = t.bars(spark, sf_dir).where("close > 0").groupBy("asset").agg(F.min("ts").alias("first_ts"), F.min_by("close", "ts").alias("first_close"))
    day = F.to_date("first_ts")
    status = F.when(F.col("first_ts").isNull(), "failed").when(day <= F.col("expected"), "early").otherwise("late")
    return listed.join(first, "asset", "left").select("asset", F.col("expected").cast("timestamp").alias("expected"), "first_ts", "first_close", F.datediff(day, "expected").cast("long").alias("lead_days"), status.alias("status"))


@query("m23_briefing", f"""WITH {D}{EV}{pr.CLOSES}{pr.CROSS}, l AS (SELECT asset, arg_max(r, ts) AS r, max(ts) AS ts FROM ret GROUP BY 1), s AS (SELECT avg(r) AS m, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) AS b, count(*) FILTER (ts < (SELECT max(ts) FROM ret) - INTERVAL 2 DAY) AS stale FROM l)
    SELECT 'mean_change' AS finding, NULL AS asset, round(m, 6) AS value FROM s UNION ALL SELECT 'breadth', NULL, round(b, 6) FROM s UNION ALL SELECT 'stale', NULL, stale FROM s
    UNION ALL SELECT * FROM (SELECT 'up', asset, round(r, 6) FROM l ORDER BY round(r, 9) DESC, asset LIMIT 4) UNION ALL SELECT * FROM (SELECT 'down', asset, round(r, 6) FROM l ORDER BY round(r, 9), asset LIMIT 4)
    UNION ALL SELECT * FROM (SELECT 'event', asset, CAST(severity AS DOUBLE) FROM me WHERE severity >= 40 AND NOT (z < 2 AND dbl < 2) AND kind <> 'mixed' AND ts >= (SELECT max(ts) FROM bars) - INTERVAL 30 DAY ORDER BY severity DESC, ts DESC, asset LIMIT 4)
    UNION ALL SELECT * FROM (SELECT 'crossing', a || '/' || b, round(spread_after, 4) FROM cr WHERE ts >= (SELECT max(ts) FROM bars) - INTERVAL 30 DAY ORDER BY ts DESC, round(abs(spread_after), 4) DESC, a, b LIMIT 4)
    UNION ALL SELECT * FROM (SELECT 'news', string_split(text, chr(10))[1], CAST(max(doc_id) AS DOUBLE) FROM documents WHERE text IS NOT NULL GROUP BY 2 ORDER BY 3 DESC LIMIT 4)""")
def briefing(spark, sf_dir):
    """The market's day: means, the four that rose and fell most, the strongest events and newest crossings of the last 30 days, the newest texts."""
    last = log_returns(t.bars(spark, sf_dir)).groupBy("asset").agg(F.max_by("r", "ts").alias("r"), F.max("ts").alias("ts"))
    now = last.agg(F.max("ts").alias("_now"))
    whole = last.join(F.broadcast(now)).agg(F.avg("r").alias("mean_change"), F.avg((F.col("r") > 0).cast("double")).alias("breadth"), F.count_if(F.col("ts") < F.col("_now") - F.expr("INTERVAL 2 DAYS")).cast("double").alias("stale"))
    none = F.lit(None).cast("string").alias("asset")
    out = whole.select(F.explode(F.create_map(F.lit("mean_change"), "mean_change", F.lit("breadth"), "breadth", F.lit("stale"), "stale")).alias("finding", "value")).select("finding", none, "value")
    top = lambda k, order: last.orderBy(order, "asset").limit(4).select(F.lit(k).alias("finding"), "asset", F.col("r").alias("value"))
    out = out.unionByName(top("up", F.desc(F.round("r", 9)))).unionByName(top("down", F.round("r", 9)))
    bars = t.bars(spark, sf_dir)
    recent = bars.agg((F.max("ts") - F.expr("INTERVAL 30 DAYS")).alias("_since"))
    found = event_ops.market_events(bars).where("kind <> 'mixed'").join(F.broadcast(recent), F.col("ts") >= F.col("_since")).orderBy(F.desc("severity"), F.desc("ts"), "asset").limit(4)
    crossed = pr.found(spark, sf_dir, "day").join(F.broadcast(recent), F.col("ts") >= F.col("_since")).orderBy(F.desc("ts"), F.desc(F.round(F.abs("spread_after"), 4)), "a", "b").limit(4)
    news = t.table(spark, sf_dir, "documents").where("text IS NOT NULL").groupBy(F.substring_index("text", "\n", 1).alias("asset")).agg(F.max("doc_id").cast("double").alias("value")).orderBy(F.desc("value")).limit(4)
    out = out.unionByName(found.select(F.lit("event").alias("finding"), "asset", F.col("severity").cast("double").alias("value")))
    out = out.unionByName(crossed.select(F.lit("crossing").alias("finding"), F.concat("a", F.lit("/"), "b").alias("asset"), F.round("spread_after", 4).alias("value")))
    return rounded(out.unionByName(news.select(F.lit("news").alias("finding"), "asset", "value")))


@query("m24_start_tiles", f"WITH {D}, {A} SELECT (SELECT max(ts) FROM bars) AS newest_bar, (SELECT count(*) FROM bars) AS n_bars, (SELECT count(*) FROM assets) AS n_assets, (SELECT count(*) FROM documents) AS n_texts, (SELECT max(o_orderdate) FROM orders) AS newest_order")
def start_tiles(spark, sf_dir):
    bars = t.bars(spark, sf_dir).agg(F.max("ts").alias("newest_bar"), F.count(F.lit(1)).alias("n_bars"))
    parts = [t.assets(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_assets")), t.table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n_texts")), t.table(spark, sf_dir, "orders").agg(F.max("o_orderdate").alias("newest_order"))]
    for part in parts:
        bars = bars.join(F.broadcast(part))
    return bars
