"""Pairs of assets: correlation, lead and lag, crossings and what they are worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.series import correlation, log_return

PAIR = ("a", "b")


def pair_window(order: str = "ts"):
    return Window.partitionBy("a", "b").orderBy(order)


def cross_correlation(pairs: DataFrame, most: int) -> DataFrame:
    """a, b, lag, r for lags -most..most of pairs (a, b, ts, ra, rb): r of ra at i with rb at i + lag, so a leads at a
    positive lag. One window and one aggregate instead of a self-join for each lag."""
    w = pair_window()
    lags = [k for k in range(-most, most + 1)]
    shifted = pairs.withColumn("_x", F.array(*[F.struct(F.lit(k).alias("lag"), F.lead("rb", k).over(w).alias("y")) for k in lags]))
    each = shifted.select("a", "b", "ra", F.explode("_x").alias("_e")).select("a", "b", "ra", "_e.lag", F.col("_e.y").alias("rb"))
    return each.where("rb IS NOT NULL").groupBy("a", "b", "lag").agg(correlation("ra", "rb").alias("r"))


def best_lag(correlations: DataFrame) -> DataFrame:
    """The lag with the largest |r| of each pair, the most negative on a tie."""
    best = F.max_by(F.struct("lag", "r"), F.struct(F.round(F.abs("r"), 9), -F.col("lag")))
    return correlations.groupBy("a", "b").agg(best.alias("_b")).select("a", "b", "_b.lag", "_b.r")


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation of two columns of each asset, ties at their mean rank."""

    def ranks(c: str) -> Column:
        return F.rank().over(Window.partitionBy("asset").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("asset", c)) - 1) / 2

    return rows.select("asset", ranks(x).alias("_x"), ranks(y).alias("_y")).groupBy("asset").agg(correlation("_x", "_y").alias("rho"))


def pair_statistics(closes: DataFrame, least: int = 60, threshold: float = 0.15, most: int = 12) -> DataFrame:
    """a, b, n, corr0, lag, lag_corr from pairs (a, b, ts, ca, cb): returns are taken on the common timestamps; the lags
    are searched only where the correlation at once reaches the threshold."""
    w = pair_window()
    returns = closes.select("a", "b", "ts", F.row_number().over(w).alias("_i"), log_return(F.col("ca"), F.lag("ca").over(w)).alias("ra"), log_return(F.col("cb"), F.lag("cb").over(w)).alias("rb")).where("_i > 1")
    now = returns.groupBy("a", "b").agg(correlation("ra", "rb").alias("corr0"), (F.count(F.lit(1)) + 1).alias("n")).where(F.col("n") >= least)
    searched = now.where(F.abs(F.round("corr0", 9)) >= threshold).select("a", "b")
    lags = best_lag(cross_correlation(returns.join(searched, ["a", "b"], "left_semi"), most)).withColumnRenamed("r", "lag_corr")
    both = now.join(lags, ["a", "b"], "left")
    return both.select("a", "b", "n", "corr0", F.coalesce("lag", F.lit(0)).alias("lag"), F.coalesce("lag_corr", "corr0").alias("lag_corr"))


def mirrored(pairs: DataFrame) -> DataFrame:
    """Pair statistics seen from either side: asset, other, r, lag (positive: asset leads)."""
    return pairs.select(F.col("a").alias("asset"), F.col("b").alias("other"), F.col("corr0").alias("r"), "lag", "lag_corr", "n").unionByName(
        pairs.select(F.col("b").alias("asset"), F.col("a").alias("other"), F.col("corr0").alias("r"), (-F.col("lag")).alias("lag"), "lag_corr", "n")
    )


def leaders(pairs: DataFrame, top: int) -> DataFrame:
    """The assets that lead each asset, by |lag correlation|."""
    led = mirrored(pairs).where("lag < 0").select("asset", F.col("other").alias("leader"), (-F.col("lag")).alias("lag"), "lag_corr")
    order = Window.partitionBy("asset").orderBy(F.desc(F.round(F.abs("lag_corr"), 9)), "leader")
    return led.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def crossings(closes: DataFrame, least: float = 0.5, most: int = 40) -> DataFrame:
    """a, b, ts, direction (1: a above b), spread_before, spread_after: where the difference of the two curves, both
    from 100, changes sign between two large values; the first ``most`` of each pair.

    Points before the first large spread and zero spreads don't count; what is left falls into runs of one sign, and
    a run is a crossing at its first point if that is large and the run before it held a large one.
    """
    w = pair_window()
    first = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spread = 100 * F.col("ca") / F.first("ca").over(first) - 100 * F.col("cb") / F.first("cb").over(first)
    rows = closes.select("a", "b", "ts", spread.alias("s")).withColumn("big", F.abs("s") >= least)
    rows = rows.withColumn("_seen", F.max("big").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_seen") & (F.col("s") != 0))
    rows = rows.withColumn("_flip", F.coalesce((F.signum("s") != F.signum(F.lag("s").over(w))).cast("int"), F.lit(0)))
    rows = rows.withColumn("_run", F.sum("_flip").over(w))
    rows = rows.withColumn("_last_big", F.last(F.when(F.col("big"), F.struct("_run", "s")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    found = rows.where((F.col("_flip") == 1) & F.col("big") & (F.col("_last_big._run") == F.col("_run") - 1))
    found = found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    return found.select("a", "b", "ts", F.when(F.col("s") > 0, 1).otherwise(0).alias("direction"), F.col("_last_big.s").alias("spread_before"), F.col("s").alias("spread_after"))


def average_crosses(bars: DataFrame, fast: int, slow: int) -> DataFrame:
    """Golden (1) and death (-1) crosses of two moving averages."""
    from tidewater.functions.series import last_rows, own

    gap = F.avg("close").over(last_rows(fast)) - F.avg("close").over(last_rows(slow))
    rows = bars.select("asset", "ts", F.when(F.row_number().over(own()) >= slow, gap).alias("gap")).withColumn("_was", F.lag("gap").over(own()))
    cross = F.when((F.col("_was") <= 0) & (F.col("gap") > 0), 1).when((F.col("_was") >= 0) & (F.col("gap") < 0), -1)
    return rows.withColumn("cross", cross).where("cross IS NOT NULL").select("asset", "ts", "cross")


def forward_gains(found: DataFrame, closes: DataFrame, bars: int) -> DataFrame:
    """Crossings with gain: what the crossing side made against the other over so many common bars."""
    w = pair_window()
    ahead = closes.select("a", "b", "ts", (F.lead("ca", bars).over(w) / F.col("ca") - 1).alias("_fa"), (F.lead("cb", bars).over(w) / F.col("cb") - 1).alias("_fb"))
    met = found.join(ahead, ["a", "b", "ts"]).where("_fa IS NOT NULL")
    return met.withColumn("gain", F.when(F.col("direction") == 1, F.col("_fa") - F.col("_fb")).otherwise(F.col("_fb") - F.col("_fa"))).drop("_fa", "_fb")


def track_record(gains: DataFrame, cost: float, least: int = 8, hit: float = 0.55) -> DataFrame:
    """Each pair's past: n, hit rate, mean gain, and whether it has proven itself after costs."""
    own = gains.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("gain") > 0).cast("double")).alias("hit_rate"), F.avg("gain").alias("mean_gain"))
    return own.withColumn("proven", (F.col("n") >= least) & (F.col("hit_rate") >= hit) & (F.col("mean_gain") - cost > 0))


def opportunities(found: DataFrame, closes: DataFrame, since: Column) -> DataFrame:
    """The latest crossing of each pair since a time, and what both sides made from it to the pair's last common bar."""
    latest = found.where(F.col("ts") >= since).groupBy("a", "b").agg(F.max(F.struct("ts", "direction")).alias("_c")).select("a", "b", "_c.ts", "_c.direction")
    last = closes.groupBy("a", "b").agg(F.max(F.struct("ts", "ca", "cb")).alias("_l"))
    met = latest.join(closes, ["a", "b", "ts"]).join(last, ["a", "b"])
    rows = met.select("a", "b", "ts", "direction", (F.col("_l.ca") / F.col("ca") - 1).alias("ret_a"), (F.col("_l.cb") / F.col("cb") - 1).alias("ret_b"))
    return rows.withColumn("pair_gain", F.when(F.col("direction") == 1, F.col("ret_a") - F.col("ret_b")).otherwise(F.col("ret_b") - F.col("ret_a")))


def class_switches(open_: DataFrame, assets: DataFrame, sound: DataFrame, switched: int = 2) -> DataFrame:
    """Opportunities with max_jump, of which one side is of the class ``switched`` and the other isn't, both sound. sound: asset, max_move of the assets that haven't
    jumped."""
    for side in "ab":
        own = assets.select(F.col("asset").alias(side), (F.col("cls") == switched).alias(f"_in_{side}")).join(sound.select(F.col("asset").alias(side), F.col("max_move").alias(f"_jump_{side}")), side)
        open_ = open_.join(own, side)
    return open_.where("_in_a <> _in_b").withColumn("max_jump", F.greatest("_jump_a", "_jump_b")).drop("_in_a", "_in_b", "_jump_a", "_jump_b")


def jump_guard(bars: DataFrame, since: Column, limit: Column) -> DataFrame:
    """The largest single-bar log move of each asset since a time, and whether it reaches the limit of its class."""
    from tidewater.functions.series import own

    step = F.abs(log_return(F.col("close"), F.lag("close").over(own())))
    return bars.withColumn("_m", step).where(F.col("ts") >= since).groupBy("asset", "cls").agg(F.max("_m").alias("max_move")).withColumn("suspect", F.col("max_move") >= limit)


def capped_ranking(ranking: DataFrame, top: int, each: int) -> DataFrame:
    """Walks a ranking (a, b, score) from the top and skips a row if either asset already has ``each`` rows.

    The walk depends on its own past, so it folds the best ``top`` rows, a limit of the report itself."""
    rows = ranking.orderBy(F.desc("score"), "a", "b").limit(top).agg(F.collect_list(F.struct("score", "a", "b")).alias("_r"))
    ordered = F.array_sort("_r", lambda x, y: F.when(x["score"] > y["score"], -1).when(x["score"] < y["score"], 1).when(F.struct(x["a"], x["b"]) < F.struct(y["a"], y["b"]), -1).otherwise(1))
    start = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast("array<struct<score:double,a:string,b:string>>").alias("out"))
    times = lambda used, s: F.size(F.filter(used, lambda u: u == s))

    def step(state: Column, row: Column) -> Column:
        fits = (times(state["used"], row["a"]) < each) & (times(state["used"], row["b"]) < each)
        used = F.when(fits, F.concat(state["used"], F.array(row["a"], row["b"]))).otherwise(state["used"])
        return F.struct(used.alias("used"), F.when(fits, F.concat(state["out"], F.array(row))).otherwise(state["out"]).alias("out"))

    kept = rows.select(F.posexplode(F.aggregate(ordered, start, step)["out"]).alias("place", "_k"))
    return kept.select((F.col("place") + 1).alias("place"), "_k.a", "_k.b", "_k.score")


def reversal_study(found: DataFrame, forwards: DataFrame, least: int) -> DataFrame:
    """Each pair's crossings against the calendar-day forward returns (asset, ts, fw): n, hits, mean gain, z."""
    fa, fb = forwards.select(F.col("asset").alias("a"), "ts", F.col("fw").alias("_fa")), forwards.select(F.col("asset").alias("b"), "ts", F.col("fw").alias("_fb"))
    met = found.join(fa, ["a", "ts"]).join(fb, ["b", "ts"]).where("_fa IS NOT NULL AND _fb IS NOT NULL")
    met = met.withColumn("gain", F.when(F.col("direction") == 1, F.col("_fa") - F.col("_fb")).otherwise(F.col("_fb") - F.col("_fa")))
    own = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gain") > 0).alias("hits"), F.avg("gain").alias("mean_gain")).where(F.col("n") >= least)
    return own.withColumn("z", (F.col("hits") - F.col("n") / 2) / F.sqrt(F.col("n") / 4))


def reversal_summary(study: DataFrame) -> DataFrame:
    return study.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("z") >= 1.96).alias("n_high"), F.count_if(F.col("z") <= -1.96).alias("n_low"), (0.025 * F.count(F.lit(1))).alias("expected_each")
    )


def region_lead(bars: DataFrame, regions: DataFrame, hours: DataFrame, least: int) -> DataFrame:
    """early, late, hours, n, early_members, late_members, r_cc, r_gap, r_oc, r_counter, overlap: how the mean log return of a region and day goes with that of a region
    that closes later the same day: close to close, overnight and within the day. Each region's assets count alike.

    The counter-check takes the late region's calendar day before; days without one drop out of the moments that need it, and only of these. An overlap of
    trading hours means that both move at once, which is no lead. regions: asset, region; hours: region, opens, closes."""
    from tidewater.functions.series import own

    before = F.lag("close").over(own())
    sound = bars.where("close > 0 AND open > 0").join(regions, "asset")
    returns = sound.select("region", F.to_date("ts").alias("day"), F.ln(F.col("close") / before).alias("cc"), F.ln(F.col("open") / before).alias("gap"), F.ln(F.col("close") / F.col("open")).alias("oc"))
    days = returns.where("cc IS NOT NULL AND gap IS NOT NULL AND oc IS NOT NULL").groupBy("region", "day").agg(F.count(F.lit(1)).alias("members"), *[F.avg(c).alias(c) for c in ("cc", "gap", "oc")]).join(hours, "region")
    early = days.select("day", F.col("region").alias("early"), F.col("closes").alias("_ends"), F.col("members").alias("_em"), F.col("cc").alias("_f"))
    late = days.select("day", F.col("region").alias("late"), "opens", "closes", F.col("members").alias("_lm"), "cc", "gap", "oc")
    prior = days.select(F.date_add("day", 1).alias("day"), F.col("region").alias("late"), F.col("cc").alias("_b"))
    met = early.join(late, "day").where(F.col("closes") > F.col("_ends")).join(prior, ["day", "late"], "left")

    def moment(x: str, y: str) -> Column:
        return F.try_divide(F.avg(F.col(x) * F.col(y)) - F.avg(x) * F.avg(y), F.stddev_pop(x) * F.stddev_pop(y))

    rows = met.groupBy("early", "late").agg(
        F.first(F.col("closes") - F.col("_ends")).alias("hours"), F.count(F.lit(1)).alias("n"), F.avg("_em").alias("early_members"), F.avg("_lm").alias("late_members"),
        *[moment("_f", c).alias(f"r_{c}") for c in ("cc", "gap", "oc")], moment("_b", "_f").alias("r_counter"), F.first(F.greatest(F.lit(0), F.col("_ends") - F.col("opens"))).alias("overlap"),
    )
    return rows.where(F.col("n") >= least)
