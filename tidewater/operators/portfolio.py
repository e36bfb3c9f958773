"""Long-term measures, intraday mobility, the ledger and rankings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.series import own, ratio

FEE, SLIPPAGE = 0.001, 0.0005
ROUND_TRIP = 2 * (FEE + SLIPPAGE)


def annual(returns: DataFrame) -> DataFrame:
    """asset, annual return and volatility from log returns r, with the trading days a year that the span really had."""
    rows = returns.groupBy("asset").agg(F.count("r").alias("n"), F.avg("r").alias("_m"), F.stddev_samp("r").alias("_s"), F.datediff(F.max("ts"), F.min("ts")).alias("_d"))
    year = F.col("n") / (F.col("_d") / 365.25)
    return rows.select("asset", "n", (F.exp(F.col("_m") * year) - 1).alias("annual_return"), (F.col("_s") * F.sqrt(year)).alias("annual_volatility"))


def max_drawdown(bars: DataFrame) -> DataFrame:
    high = F.max("close").over(own().rowsBetween(Window.unboundedPreceding, 0))
    return bars.withColumn("_d", 1 - F.col("close") / high).groupBy("asset").agg(F.max("_d").alias("max_drawdown"))


def rolling_windows(bars: DataFrame, n: int) -> DataFrame:
    """Returns over n bars from every start: share positive, worst and best."""
    r = F.col("close") / F.lag("close", n).over(own()) - 1
    return bars.withColumn("_r", r).where("_r IS NOT NULL").groupBy("asset").agg(F.count(F.lit(1)).alias("windows"), F.avg((F.col("_r") > 0).cast("double")).alias("share_positive"), F.min("_r").alias("worst"), F.max("_r").alias("best"))


def basket_returns(returns: DataFrame, baskets: DataFrame) -> DataFrame:
    """basket, ts, r: the mean return of a basket's members at the timestamps that all of them have."""
    sizes = baskets.groupBy("basket").agg(F.count(F.lit(1)).alias("_size"))
    rows = returns.join(baskets, "asset").groupBy("basket", "ts").agg(F.avg("r").alias("r"), F.count(F.lit(1)).alias("_n"))
    return rows.join(sizes, "basket").where("_n = _size").select("basket", "ts", "r")


def basket_holdout(returns: DataFrame, baskets: DataFrame, half: Column, year: int) -> DataFrame:
    """basket, n, annual_return, annual_volatility, max_drawdown, positive_years, mean_correlation, max_correlation, drift: how equally weighted baskets do on the
    half that their choice hasn't seen, at the timestamps that all members have.

    positive_years is the share of windows of ``year`` returns that gain, drift by how much the highest correlation of two members has grown since the
    choice. returns: asset, ts, r (log)."""
    sizes = baskets.groupBy("basket").agg(F.count(F.lit(1)).alias("_size"))
    member = returns.join(baskets, "asset")
    common = member.groupBy("basket", "ts").agg(F.count(F.lit(1)).alias("_n")).join(sizes, "basket").where("_n = _size").select("basket", "ts")
    rows = member.join(common, ["basket", "ts"], "left_semi").withColumn("late", F.col("ts") >= half)
    w = Window.partitionBy("basket").orderBy("ts")
    curve = rows.where("late").groupBy("basket", "ts").agg(F.avg("r").alias("r")).withColumn("_v", F.exp(F.sum("r").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    curve = curve.withColumn("_d", 1 - F.col("_v") / F.greatest(F.lit(1.0), F.max("_v").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    gain = F.when(F.count(F.lit(1)).over(w.rowsBetween(1 - year, 0)) == year, (F.sum("r").over(w.rowsBetween(1 - year, 0)) > 0).cast("double"))
    own_ = curve.withColumn("_y", gain).groupBy("basket").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("_m"), F.stddev_samp("r").alias("_s"), F.datediff(F.max("ts"), F.min("ts")).alias("_days"), F.max("_d").alias("max_drawdown"), F.avg("_y").alias("positive_years"))
    x, y = (rows.select("basket", "ts", "late", F.col("asset").alias(a), F.col("r").alias(r)) for a, r in (("a", "ra"), ("b", "rb")))
    pairs = x.join(y, ["basket", "ts", "late"]).where("a < b").groupBy("basket", "late", "a", "b").agg(F.corr("ra", "rb").alias("c"))
    found = pairs.groupBy("basket").agg(F.avg(F.when(F.col("late"), F.col("c"))).alias("mean_correlation"), F.max(F.when(F.col("late"), F.col("c"))).alias("max_correlation"), F.max(F.when(~F.col("late"), F.col("c"))).alias("_chosen"))
    scale = F.try_divide(F.col("n"), F.col("_days") / 365.25)
    return own_.join(found, "basket").select("basket", "n", (F.exp(F.col("_m") * scale) - 1).alias("annual_return"), (F.col("_s") * F.sqrt(scale)).alias("annual_volatility"), "max_drawdown", "positive_years", "mean_correlation", "max_correlation", (F.col("max_correlation") - F.col("_chosen")).alias("drift"))


def mobility(bars: DataFrame, by: list[str]) -> DataFrame:
    """Mean and median size of a bar's log move, and how often it beats one and two round trips."""
    moves = bars.withColumn("m", F.abs(F.ln(F.col("close") / F.lag("close").over(own())))).where("m IS NOT NULL")
    above = lambda k: F.avg((F.col("m") > k * ROUND_TRIP).cast("double"))
    return moves.groupBy(*by).agg(F.avg("m").alias("mean_move"), F.percentile("m", F.lit(0.5)).alias("median_move"), above(1).alias("above_one"), above(2).alias("above_two"))


def movers(bars: DataFrame, top: int) -> DataFrame:
    """The newest close of each asset against the one before and five before, by size of the move; from a price of 0 it is infinite."""
    order = Window.partitionBy("asset").orderBy(F.desc("ts"))
    rows = bars.withColumn("_n", F.row_number().over(order)).where("_n <= 6")
    at = lambda k: F.max(F.when(F.col("_n") == k, F.col("close")))
    last = rows.groupBy("asset").agg((ratio(at(1), at(2)) - 1).alias("move"), (ratio(at(1), at(6)) - 1).alias("move5"), (ratio(F.max("high"), F.min("low")) - 1).alias("range"))
    return last.orderBy(F.desc(F.round(F.abs("move"), 9)), "asset").limit(top)


def expectancy(hit: Column, move: Column) -> Column:
    """What a call is worth: (2 p - 1) m less the round trip."""
    return (2 * hit - 1) * move - ROUND_TRIP


def after_cost(gross: Column) -> Column:
    return gross - ROUND_TRIP


def required_hit(move: Column) -> Column:
    """The hit rate from which calls on such a move are worth their cost; 1 without any move."""
    return F.when(move <= 0, 1.0).otherwise(F.try_divide(ROUND_TRIP / F.when(move > 0, move) + 1, F.lit(2.0)))


def positions(bookings: DataFrame, prices: DataFrame) -> DataFrame:
    """Shares, money in and out, fees and value of each depot and asset. bookings: depot, asset, at, shares (signed), amount, fee."""
    rows = bookings.groupBy("depot", "asset").agg(
        F.sum("shares").alias("shares"), F.sum(F.when(F.col("shares") > 0, F.col("amount")).otherwise(0)).alias("paid_in"), F.sum(F.when(F.col("shares") < 0, F.col("amount")).otherwise(0)).alias("taken_out"), F.sum("fee").alias("fees"), F.min("booked").alias("first_booked"),
    )
    return rows.join(prices.select("asset", F.col("close").alias("price")), "asset", "left").withColumn("value", F.col("shares") * F.col("price"))


def cash_accounts(moves: DataFrame) -> DataFrame:
    """Balance, deposits, withdrawals and fees of each depot. moves: depot, booked, amount (signed), reason."""
    of = lambda reason: F.sum(F.when(F.col("reason") == reason, F.col("amount")).otherwise(0))
    return moves.groupBy("depot").agg(F.sum("amount").alias("balance"), of("deposit").alias("deposits"), of("withdrawal").alias("withdrawals"), of("fee").alias("fees"))


def journal(moves: DataFrame) -> DataFrame:
    """The moves of each depot with the balance after each."""
    order = Window.partitionBy("depot").orderBy("booked", "ord").rowsBetween(Window.unboundedPreceding, 0)
    return moves.withColumn("balance", F.sum("amount").over(order))


def wealth_curve(bookings: DataFrame, moves: DataFrame, bars: DataFrame) -> DataFrame:
    """depot, ts, wealth: at each timestamp of the bars, shares held so far at the last known price, and the cash so far."""
    calendar = bars.select("ts").distinct()
    held = bookings.groupBy("depot", "asset", F.col("booked").alias("ts")).agg(F.sum("shares").alias("_s"))
    pairs = bookings.select("depot", "asset").distinct()
    prices = bars.select("asset", "ts", F.col("close").alias("_p"))
    rows = pairs.crossJoin(calendar).join(prices, ["asset", "ts"], "left").withColumn("_s", F.lit(None).cast("double")).withColumn("_grid", F.lit(1))
    rows = rows.unionByName(held.select("depot", "asset", "ts", F.lit(None).cast("double").alias("_p"), F.col("_s").cast("double").alias("_s"), F.lit(0).alias("_grid")))
    w = Window.partitionBy("depot", "asset").orderBy("ts", "_grid").rowsBetween(Window.unboundedPreceding, 0)
    at = rows.withColumn("_sh", F.sum("_s").over(w)).withColumn("_pr", F.last("_p", ignorenulls=True).over(w)).where("_grid = 1")
    stock = at.groupBy("depot", "ts").agg(F.sum(F.coalesce(F.col("_sh") * F.col("_pr"), F.lit(0.0))).alias("positions"))
    cash = moves.groupBy("depot", F.col("booked").alias("ts")).agg(F.sum("amount").cast("double").alias("_c"))
    both = stock.withColumn("_c", F.lit(None).cast("double")).withColumn("_grid", F.lit(1)).unionByName(cash.select("depot", "ts", F.lit(None).cast("double").alias("positions"), "_c", F.lit(0).alias("_grid")))
    wd = Window.partitionBy("depot").orderBy("ts", "_grid").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("cash", F.coalesce(F.sum("_c").over(wd), F.lit(0.0))).where("_grid = 1").select("depot", "ts", "positions", "cash", (F.col("positions") + F.col("cash")).alias("wealth"))


def indexed(curve: DataFrame, key: str, value: str) -> DataFrame:
    """curve with index: 100 at the first positive value of its key."""
    w = Window.partitionBy(key).orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return curve.withColumn("index", 100 * F.col(value) / F.first(F.when(F.col(value) > 0, F.col(value)), ignorenulls=True).over(w))


def shrunken(counts: DataFrame) -> DataFrame:
    """asset, n, hits -> hit_rate and its empirical-Bayes estimate: shrunk to the pooled mean by how much of the spread
    between assets binomial noise explains. Needs ten assets; with no spread beyond noise all get the mean."""
    rows = counts.where("n > 0").withColumn("hit_rate", F.col("hits") / F.col("n"))
    pooled = rows.agg((F.sum("hits") / F.sum("n")).alias("_m"), F.var_samp("hit_rate").alias("_v"), F.count(F.lit(1)).alias("_a"))
    noise = rows.join(F.broadcast(pooled)).agg(F.avg(F.col("_m") * (1 - F.col("_m")) / F.col("n")).alias("_noise"))
    both = rows.join(F.broadcast(pooled)).join(F.broadcast(noise)).withColumn("_true", F.col("_v") - F.col("_noise"))
    k = F.col("_m") * (1 - F.col("_m")) / F.col("_true")
    return both.select("asset", "n", "hit_rate", F.when(F.col("_a") < 10, F.col("hit_rate")).when(F.col("_true") <= 0, F.col("_m")).otherwise((F.col("_m") * k + F.col("hits")) / (k + F.col("n"))).alias("shrunk"))


def decorrelated(ranking: DataFrame, pairs: DataFrame, top: int, limit: float) -> DataFrame:
    """Walks the best ``top`` of a ranking (asset, score) and drops an asset too correlated with one kept before."""
    close = pairs.where(F.abs("r") > limit).select(F.col("a").alias("asset"), F.col("b").alias("_o")).unionByName(pairs.where(F.abs("r") > limit).select(F.col("b").alias("asset"), F.col("a").alias("_o")))
    near = close.groupBy("asset").agg(F.collect_set("_o").alias("_near"))
    best = ranking.orderBy(F.desc("score"), "asset").limit(top).join(near, "asset", "left").withColumn("_near", F.coalesce("_near", F.array().cast("array<string>")))
    rows = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "asset", "_near"))).alias("_r"))
    kept = F.aggregate("_r", F.array().cast("array<string>"), lambda acc, x: F.when(F.arrays_overlap(acc, x["_near"]), acc).otherwise(F.concat(acc, F.array(x["asset"]))))
    return rows.select(F.posexplode(kept).alias("place", "asset")).select((F.col("place") + 1).alias("place"), "asset")


def total(wealth: DataFrame, rates: DataFrame, series: dict[str, str]) -> DataFrame:
    """ts, total, gain: all depots in one currency. wealth: depot, ts, wealth, paid (what was paid in by then). rates: series, ts, rate, filled
    forward. series: which rate a depot's currency has; other depots are in the target currency. Before a rate's first value its depot is left out."""
    foreign = F.create_map(*[F.lit(x) for pair in series.items() for x in pair])[F.col("depot")]
    met = wealth.withColumn("series", foreign).join(rates, ["series", "ts"], "left").withColumn("_r", F.when(F.col("series").isNull(), 1.0).otherwise(F.col("rate")))
    sums = met.groupBy("ts").agg(F.sum(F.col("wealth") * F.col("_r")).alias("total"), F.sum(F.col("paid") * F.col("_r")).alias("_p"))
    return sums.select("ts", "total", (F.col("total") - F.col("_p")).alias("gain"))


def greedy_baskets(returns: DataFrame, sizes: tuple[int, ...] = (3, 5, 8), candidates: int = 40, most: float = 0.9, least: int = 30) -> DataFrame:
    """size, place, asset, deviation: baskets that start with the best return for its deviation and take the candidate that lowers
    the basket's deviation most, none that correlates above ``most`` with a member. Sizes that can't be filled are left out.

    returns: asset, ts, r of the selection part only. Spark ranks the assets and makes the covariances of at most ``candidates`` of them on the
    timestamps that all have; the choice from that small matrix is one task."""
    best = returns.where("r IS NOT NULL").groupBy("asset").agg((F.avg("r") / F.stddev_samp("r")).alias("_q")).orderBy(F.desc(F.round("_q", 9)), "asset").limit(candidates)
    best = best.withColumn("_place", F.row_number().over(Window.orderBy(F.desc(F.round("_q", 9)), "asset")))
    rows = returns.where("r IS NOT NULL").join(best, "asset")
    full = rows.groupBy("ts").agg(F.count(F.lit(1)).alias("_n")).join(F.broadcast(best.agg(F.count(F.lit(1)).alias("_all")))).where("_n = _all").select("ts")
    rows = rows.join(full, "ts", "left_semi")
    x, y = rows.select("ts", F.col("_place").alias("a"), F.col("asset"), F.col("r").alias("ra")), rows.select("ts", F.col("_place").alias("b"), F.col("r").alias("rb"))
    pairs = x.join(y, "ts").groupBy("a", "b", "asset").agg(F.covar_samp("ra", "rb").alias("c"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        m = part.pivot(index="a", columns="b", values="c").to_numpy()
        names = part.drop_duplicates("a").sort_values("a")["asset"].to_list()
        r, out = m / np.sqrt(np.outer(np.diag(m), np.diag(m))), []
        for size in sizes:
            own_ = [0]
            while len(own_) < size:
                open_ = [j for j in range(len(m)) if j not in own_ and (r[j, own_] <= most).all()]
                if not open_:
                    break
                own_.append(min(open_, key=lambda j: m[np.ix_([*own_, j], [*own_, j])].sum()))
            if len(own_) == size:
                deviation = float(np.sqrt(m[np.ix_(own_, own_)].sum()) / size)
                out += [(size, place, names[j], deviation) for place, j in enumerate(own_, 1)]
        return pd.DataFrame(out, columns=["size", "place", "asset", "deviation"])

    return pairs.groupBy(F.lit(1).alias("_one")).applyInPandas(choose, "size int, place int, asset string, deviation double")
