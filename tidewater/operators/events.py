"""Market events, transmission between assets and shapes of curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.series import clamp, last_rows, log_return, own, severity

from .nearest import top_products


def market_events(bars: DataFrame, w: int = 60, least: float = 40.0) -> DataFrame:
    """Bars whose move, volume or range stands out from the w bars before: magnitude, severity, kind, direction, suspect."""
    before = last_rows(w, 1)
    rows = bars.withColumn("r", log_return(F.col("close"), F.lag("close").over(own()))).withColumn("i", F.row_number().over(own()))
    rows = rows.withColumn("range", F.try_divide(F.col("high") - F.col("low"), F.col("close")))
    median = lambda x: F.percentile(x, F.lit(0.5)).over(before)
    rows = rows.withColumn("_r", median(F.abs("r"))).withColumn("_v", median(F.col("volume"))).withColumn("_g", median(F.col("range"))).where((F.col("i") > w + 1) & (F.col("_r") > 1e-9))
    factor = F.try_divide(F.col("volume"), F.when(F.col("_v") > 0, F.col("_v")))
    rows = rows.withColumn("z", F.abs("r") / (1.4826 * F.col("_r"))).withColumn("volume_factor", F.coalesce(factor, F.lit(1.0)))
    rows = rows.withColumn("doublings", F.when(F.col("volume_factor") > 0, F.log2("volume_factor")).otherwise(0.0)).withColumn("range_z", F.coalesce(F.try_divide(F.col("range"), F.when(F.col("_g") > 0, F.col("_g"))) - 1, F.lit(0.0)))
    rows = rows.withColumn("magnitude", F.col("z") + 0.6 * clamp(F.col("doublings"), 0.0, 4.0) + 0.3 * clamp(F.col("range_z"), 0.0, 3.0)).withColumn("severity", severity(F.col("magnitude")))
    rows = rows.where((F.col("severity") >= least) & ~((F.col("z") < 2) & (F.col("doublings") < 2)))
    move, crowd, wide = F.col("z") >= 3, F.col("doublings") >= 1.5, F.col("range_z") > 0.5
    kind = F.when(move & crowd, "move_on_volume").when(move, "move").when(crowd, "volume").when(wide, "range").otherwise("mixed")
    return rows.select("asset", "ts", "z", "magnitude", "severity", kind.alias("kind"), F.signum("r").cast("int").alias("direction"), ((F.col("z") >= 10) & (F.col("volume_factor") < 1.5)).alias("suspect"))


def transmission(events: DataFrame, ahead: DataFrame, least: int = 12) -> DataFrame:
    """What followers did after leaders' events: mean signed sum of the next bars, consistency and t.

    events: leader, ts, sign; ahead: follower, ts, ahead (the sum of the follower's neutral returns over the next bars)."""
    met = events.join(ahead, "ts").where("leader <> follower AND ahead IS NOT NULL").withColumn("x", F.col("sign") * F.col("ahead"))
    rows = met.groupBy("leader", "follower").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("_s"), F.avg((F.col("x") > 0).cast("double")).alias("_p")).where(F.col("n") >= least)
    return rows.select("leader", "follower", "n", "mean", F.greatest("_p", 1 - F.col("_p")).alias("consistency"), F.try_divide(F.col("mean"), F.col("_s") / F.sqrt("n")).alias("t"))


def confirmed(train: DataFrame, test: DataFrame, top: int, least_t: float = 2.0) -> DataFrame:
    """The strongest links of one period and how many keep their sign in the next."""
    best = train.where(F.abs("t") >= least_t).orderBy(F.desc(F.round(F.abs("t"), 9)), "leader", "follower").limit(top)
    both = best.join(test.select("leader", "follower", F.col("mean").alias("_m")), ["leader", "follower"])
    return both.agg(F.count(F.lit(1)).alias("links"), F.avg((F.signum("mean") == F.signum("_m")).cast("double")).alias("same_sign"))


def scan(train: DataFrame, test: DataFrame, top: int, least_t: float = 2.0) -> DataFrame:
    """The strongest links of one period with what became of them in the next: confirmed (same sign, |t| large again), weak (same
    sign), refuted, or untested where the next period has too few events."""
    best = train.where(F.abs("t") >= least_t).orderBy(F.desc(F.round(F.abs("t"), 9)), "leader", "follower").limit(top)
    both = best.join(test.select("leader", "follower", F.col("mean").alias("_m"), F.col("t").alias("t_test")), ["leader", "follower"], "left")
    same = F.signum("mean") == F.signum("_m")
    verdict = F.when(F.col("_m").isNull(), "untested").when(same & (F.abs("t_test") >= least_t), "confirmed").when(same, "weak").otherwise("refuted")
    return both.select("leader", "follower", "n", "t", "mean", F.col("_m").alias("mean_test"), "t_test", verdict.alias("verdict"))


def scan_verdict(scanned: DataFrame) -> DataFrame:
    """One row on scanned links: checked, same (with the sign of the learning period), share in percent, mean_t, mean_test (the test period's mean in the learned direction), verdict:
    too few under ten, repeated from 60 % with a gain, weak from 55 %, else not repeated. scanned: t, mean, mean_test (null: untested)."""
    known = F.col("mean_test").isNotNull()
    same = F.count_if(known & (F.signum("mean") == F.signum("mean_test")))
    rows = scanned.agg(F.count_if(known).alias("checked"), same.alias("same"), F.avg(F.when(known, F.abs("t"))).alias("mean_t"), F.avg(F.when(known, F.signum("mean") * F.col("mean_test"))).alias("mean_test"))
    rows = rows.withColumn("share", F.try_divide(100 * F.col("same"), F.col("checked")))
    verdict = F.when(F.col("checked") < 10, "too_few").when((F.col("share") >= 60) & (F.col("mean_test") > 0), "repeated").when(F.col("share") >= 55, "weak").otherwise("not_repeated")
    return rows.select("checked", "same", "share", "mean_t", "mean_test", verdict.alias("verdict"))


def shuffled_events(rows: DataFrame, least: float) -> DataFrame:
    """As many events of each leader as it has moves beyond ``least``, at positions that a digest draws: leader, ts, sign.
    The draw is the same in every run. rows: asset, ts, r."""
    whole = Window.partitionBy("asset")
    drawn = F.row_number().over(whole.orderBy(F.md5(F.concat_ws("|", "asset", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))), "ts"))
    kept = rows.withColumn("_k", drawn).withColumn("_n", F.count_if(F.abs("r") > least).over(whole)).where("_k <= _n")
    return kept.select(F.col("asset").alias("leader"), "ts", F.signum("r").alias("sign"))


def shape_windows(bars: DataFrame, n: int, ahead: int, step: int) -> DataFrame:
    """asset, ts, shape, forward: log-price windows of n bars, standardised, every ``step`` bars, with the return after."""
    x = F.ln("close")
    w = own().rowsBetween(-(n - 1), 0)
    rows = bars.where("close > 0").withColumn("x", x).withColumn("i", F.row_number().over(own())).withColumn("shape", F.collect_list("x").over(w)).withColumn("forward", F.lead("x", ahead).over(own()) - F.col("x"))
    rows = rows.withColumn("_m", F.avg("x").over(w)).withColumn("_s", F.stddev_pop("x").over(w)).where((F.size("shape") == n) & (F.col("i") % step == 0) & (F.col("_s") > 1e-12))
    return rows.select("asset", "ts", "i", F.transform("shape", lambda v: (v - F.col("_m")) / F.col("_s")).alias("shape"), "forward")


def similar_shapes(queries: DataFrame, pool: DataFrame, top: int, gap: int) -> DataFrame:
    """q_asset, q_i, asset, i, forward, r, rank: the pool's windows that correlate most with each query window; overlapping ones of the same asset don't count."""
    scaled = F.transform("shape", lambda v: v / F.sqrt(F.size("shape")))
    asked = queries.select(F.col("asset").alias("q_asset"), F.col("i").alias("q_i"), scaled.alias("vector"))
    apart = lambda rows, q: ((rows["asset"] != q.q_asset) | ((rows["i"] - q.q_i).abs() >= gap)).to_numpy()
    return top_products(asked, pool.select("asset", "i", "forward", scaled.alias("vector")), top, ["asset", "i"], apart)


def consensus(matches: DataFrame, least: float = 0.7) -> DataFrame:
    """What followed the matches of each query: mean forward return and how far they agree on its sign."""
    good = matches.where((F.col("r") >= least) & F.col("forward").isNotNull())
    up = F.avg((F.col("forward") > 0).cast("double"))
    return good.groupBy("q_asset", "q_i").agg(F.count(F.lit(1)).alias("n"), F.avg("forward").alias("mean_forward"), F.greatest(up, 1 - up).alias("agreement"))
