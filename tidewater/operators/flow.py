"""Capital flow: shares of traded money, its moves between assets, anomalies, overhang and factor tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.series import correlation, last_rows, location, log_return, money_flow, own, severity


def with_flow(bars: DataFrame, assets: DataFrame) -> DataFrame:
    """bars with cls, gross (traded money) and net (gross signed by where the bar closes)."""
    rows = bars.join(assets.select("asset", "cls"), "asset").withColumn("gross", money_flow(F.col("close"), F.col("volume"), F.col("cls")))
    return rows.withColumn("net", F.col("gross") * location(F.col("open"), F.col("high"), F.col("low"), F.col("close")))


def shares(flow: DataFrame) -> DataFrame:
    """flow with share of the timestamp's gross, and rotation against the mean share of the 20 bars before."""
    rows = flow.withColumn("share", F.col("gross") / F.sum("gross").over(Window.partitionBy("ts")))
    return rows.withColumn("rotation", F.try_divide(F.col("share"), F.avg("share").over(last_rows(20, 1))) - 1)


def volume_z(bars: DataFrame, w: int = 20) -> DataFrame:
    """bars with volume_z against the bars before; 0 for fewer than five of them or no spread."""
    before = last_rows(w, 1)
    sd = F.stddev_samp("volume").over(before)
    return bars.withColumn("volume_z", F.when((F.count("volume").over(before) >= 5) & (sd > 0), F.try_divide(F.col("volume") - F.avg("volume").over(before), sd)).otherwise(0.0))


def market_flow(flow: DataFrame) -> DataFrame:
    """ts, gross, net, cumulative net, and the share of each class in the gross."""
    own_ = flow.groupBy("ts").agg(
        F.sum("gross").alias("gross"), F.sum("net").alias("net"), *[(F.sum(F.when(F.col("cls") == k, F.col("gross")).otherwise(0.0)) / F.sum("gross")).alias(f"share_{k}") for k in range(4)]
    )
    return own_.withColumn("net_total", F.sum("net").over(Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)))


def contributors(flow: DataFrame, days: int) -> DataFrame:
    """Each asset's gross, net and share in the last ``days`` days against the same span before."""
    now = flow.agg(F.max("ts").alias("_now"))
    age = F.datediff("_now", "ts")
    rows = flow.join(F.broadcast(now)).withColumn("_recent", age < days).where(age < 2 * days)
    part = lambda c, recent: F.sum(F.when(F.col("_recent") == recent, F.col(c)).otherwise(0.0))
    sums = rows.groupBy("asset", "cls").agg(part("gross", True).alias("gross"), part("net", True).alias("net"), part("gross", False).alias("_before"))
    whole = Window.partitionBy()
    share, before = F.col("gross") / F.sum("gross").over(whole), F.try_divide(F.col("_before"), F.sum("_before").over(whole))
    return sums.select("asset", "cls", "gross", "net", share.alias("share"), (share - before).alias("share_change"))


def rotation_pairs(flow: DataFrame, least: int = 30, below: float = -0.1) -> DataFrame:
    """Pairs whose shares of their common flow move against each other."""
    x, y = flow.select(F.col("asset").alias("a"), "ts", F.col("gross").alias("ga")), flow.select(F.col("asset").alias("b"), "ts", F.col("gross").alias("gb"))
    total = flow.groupBy("ts").agg(F.sum("gross").alias("_all"))
    w = Window.partitionBy("a", "b").orderBy("ts")
    rows = x.join(y, "ts").where("a < b").join(total, "ts").select("a", "b", "ts", (F.col("ga") / F.col("_all")).alias("sa"), (F.col("gb") / F.col("_all")).alias("sb"))
    rows = rows.withColumn("da", F.col("sa") - F.lag("sa").over(w)).withColumn("db", F.col("sb") - F.lag("sb").over(w)).where("da IS NOT NULL")
    return rows.groupBy("a", "b").agg(correlation("da", "db", 10).alias("score"), F.count(F.lit(1)).alias("n")).where((F.col("n") >= least) & (F.col("score") < below))


def participants(flow: DataFrame, calendar: DataFrame, lag: int) -> DataFrame:
    """asset, k, before, now: gross of the assets that traded at calendar positions k - 1 and k - 1 + lag, at the step's
    later end, for steps with two of them at least. calendar: ts and its position k."""
    rows = flow.where("gross > 0").join(calendar, "ts").select("asset", "cls", "k", "gross")
    later = rows.select("asset", (F.col("k") - lag).alias("k"), F.col("gross").alias("now"))
    both = rows.join(later, ["asset", "k"]).select("asset", "cls", "k", F.col("gross").alias("before"), "now")
    step = Window.partitionBy("k")
    both = both.withColumn("n", F.count(F.lit(1)).over(step)).withColumn("total_before", F.sum("before").over(step)).withColumn("total_now", F.sum("now").over(step))
    return both.where("n >= 2").withColumn("change", F.col("now") / F.col("total_now") - F.col("before") / F.col("total_before"))


def attribution(steps: DataFrame, threshold: float = 0.0002) -> DataFrame:
    """Edges (from, to, moved): what losers of share passed to gainers, in proportion to both, summed over all steps."""
    step = Window.partitionBy("k")
    rows = steps.withColumn("gain", F.when(F.col("change") > threshold, F.col("change")).otherwise(0.0)).withColumn("loss", F.when(F.col("change") < -threshold, -F.col("change")).otherwise(0.0))
    rows = rows.withColumn("_g", F.sum("gain").over(step)).withColumn("_l", F.sum("loss").over(step)).where("_g > 0 AND _l > 0").withColumn("_moved", F.least("_g", "_l") * F.col("total_now"))
    losers = rows.where("loss > 0").select(F.col("asset").alias("from_asset"), "k", (F.col("_moved") * F.col("loss") / F.col("_l")).alias("_out"))
    gainers = rows.where("gain > 0").select(F.col("asset").alias("to_asset"), "k", (F.col("gain") / F.col("_g")).alias("_part"))
    return losers.join(gainers, "k").groupBy("from_asset", "to_asset").agg(F.sum(F.col("_out") * F.col("_part")).alias("moved"), F.count(F.lit(1)).alias("steps"))


def size_changes(steps: DataFrame) -> DataFrame:
    """The market's own in- and outflow over the steps, and how many took part on average."""
    each = steps.groupBy("k").agg(F.max("total_now").alias("_n"), F.max("total_before").alias("_b"), F.max("n").alias("_p"))
    d = F.col("_n") - F.col("_b")
    return each.agg(F.sum(F.greatest(d, F.lit(0.0))).alias("inflow"), F.sum(F.greatest(-d, F.lit(0.0))).alias("outflow"), F.count(F.lit(1)).alias("steps"), F.avg("_p").alias("mean_participants"))


def grouped_attribution(edges: DataFrame, groups: DataFrame, by: str) -> DataFrame:
    """Edges between groups of assets; moves inside a group are left out."""
    x, y = groups.select(F.col("asset").alias("from_asset"), F.col(by).alias("from_group")), groups.select(F.col("asset").alias("to_asset"), F.col(by).alias("to_group"))
    return edges.join(x, "from_asset").join(y, "to_asset").where("from_group <> to_group").groupBy("from_group", "to_group").agg(F.sum("moved").alias("moved"))


def anomalies(steps: DataFrame, w: int = 60, least: int = 40) -> DataFrame:
    """Steps at which the market's flow or its distribution moved far more than in the ``w`` steps before."""
    each = steps.groupBy("k").agg(F.ln(F.max("total_now") / F.max("total_before")).alias("change"), (F.sum(F.abs("change")) / 2).alias("turnover"))
    before = Window.orderBy("k").rowsBetween(-w, -1)
    full = F.count(F.lit(1)).over(before) == w
    median = lambda x: F.percentile(x, F.lit(0.5)).over(before)
    each = each.withColumn("_c", F.when(full, median(F.abs("change")))).withColumn("_t", F.when(full, median(F.col("turnover")))).where("_c > 1e-9 AND _t > 1e-9")
    zc, zt = F.abs("change") / (1.4826 * F.col("_c")), F.greatest(F.lit(0.0), F.col("turnover") / F.col("_t") - 1)
    each = each.withColumn("z_change", zc).withColumn("z_turnover", zt).withColumn("_sc", severity(F.col("z_change"))).withColumn("_st", severity(2 * F.col("z_turnover")))
    kind = F.when(F.col("_st") > F.col("_sc"), "redistribution").when(F.col("change") > 0, "inflow").otherwise("outflow")
    return each.select("k", kind.alias("kind"), "z_change", "z_turnover", F.greatest("_sc", "_st").alias("severity")).where(F.col("severity") >= least)


def coincidence(matched: DataFrame, sizes: DataFrame, width: int) -> DataFrame:
    """How often each asset's events (asset, i, lag, hit) fall near an anomaly against chance; sizes: one row with the
    numbers of anomalies and of days, _an and _days."""
    own_ = matched.groupBy("asset").agg(F.count(F.lit(1)).alias("events"), F.count_if("hit").alias("hits"), F.avg(F.when(F.col("hit"), F.col("lag"))).alias("mean_lag"), F.avg(F.when(F.col("hit"), (F.col("lag") < 0).cast("double"))).alias("lead_share"))
    chance = F.least(F.lit(1.0), F.col("_an") * (2 * width + 1) / F.col("_days"))
    return own_.join(F.broadcast(sizes)).withColumn("lift", F.try_divide(F.col("hits") / F.col("events"), chance)).drop("_an", "_days")


def overhang(bars: DataFrame, half_life: int = 60, least: int = 20) -> DataFrame:
    """bars with overhang: how far the close stands above the volume-weighted cost of the bars before, older volume
    counting less by half every ``half_life`` bars. A weight that grows from bar to bar does it in two window sums."""
    w = last_rows(8 * half_life, 1)
    rows = bars.withColumn("_i", F.row_number().over(own())).withColumn("_w", F.col("volume") * F.pow(F.lit(2.0), F.pmod(F.col("_i"), F.lit(100000)) / half_life))
    basis = F.try_divide(F.sum(F.col("_w") * F.col("close")).over(w), F.sum("_w").over(w))
    return rows.withColumn("overhang", F.when(F.count(F.lit(1)).over(w) >= least, F.col("close") / basis - 1)).drop("_i", "_w")


def market_neutral(bars: DataFrame, least: int = 3) -> DataFrame:
    """bars with r and neutral: the return less the mean of all assets at that time, null for fewer than ``least``."""
    rows = bars.withColumn("r", log_return(F.col("close"), F.lag("close").over(own())))
    at = Window.partitionBy("ts")
    return rows.withColumn("neutral", F.when(F.count(F.lit(1)).over(at) >= least, F.col("r") - F.avg("r").over(at)))


def forward_sum(rows: DataFrame, value: str, h: int) -> DataFrame:
    """rows with ahead: the sum of the next h values of the asset, null without so many."""
    ahead = own().rowsBetween(1, h)
    return rows.withColumn("ahead", F.when(F.count(value).over(ahead) == h, F.sum(value).over(ahead)))


def with_tile(rows: DataFrame, value: str, name: str, by: tuple[str, ...] = (), tiles: int = 5, parts: int = 64) -> DataFrame:
    """rows with the ntile by (value, asset, ts), in each group of by: what ntile over one window gives, without one task
    that sorts all rows. Rows are numbered inside parts between approximate quantiles; the parts' counts add up to where each begins. A value that
    fills more than a part falls into parts of its own, one an asset, so that no part holds more than a few quantiles or one asset's history."""
    cuts = rows.groupBy(*by).agg(F.percentile_approx(value, [k / parts for k in range(1, parts)], 10 * parts).alias("_cuts"))
    dealt = rows.join(F.broadcast(cuts), list(by)) if by else rows.crossJoin(F.broadcast(cuts))
    part, full = F.size(F.filter("_cuts", lambda c: c < F.col(value))), F.size(F.filter("_cuts", lambda c: c == F.col(value))) > 1
    dealt = dealt.withColumn("_part", part).withColumn("_of", F.when(full, F.col("asset")).otherwise(F.lit(""))).drop("_cuts")  # the others of the part come first
    before, whole = Window.partitionBy(*by).orderBy("_part", "_of").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    sizes = dealt.groupBy(*by, "_part", "_of").agg(F.count(F.lit(1)).alias("_k"))
    sizes = sizes.select(*by, "_part", "_of", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"), F.sum("_k").over(whole).alias("_n"))
    rank = F.row_number().over(Window.partitionBy(*by, "_part", "_of").orderBy(value, "asset", "ts")) + F.col("_before")
    placed = dealt.join(sizes, [*by, "_part", "_of"]).withColumn("_rank", rank)
    base, more = F.floor(F.col("_n") / tiles), F.col("_n") % tiles  # the first tiles have one row more
    wide = more * (base + 1)
    tile = F.when(F.col("_rank") <= wide, F.ceil(F.col("_rank") / (base + 1))).otherwise(more + F.ceil((F.col("_rank") - wide) / F.when(base > 0, base)))
    return placed.withColumn(name, tile.cast("int")).drop("_part", "_of", "_before", "_n", "_rank")


def quintile_study(rows: DataFrame, feature: str) -> DataFrame:
    """Mean and count of ``ahead`` in each fifth of a feature."""
    n = rows.where(f"{feature} IS NOT NULL AND ahead IS NOT NULL")
    return with_tile(n, feature, "fifth").groupBy("fifth").agg(F.avg("ahead").alias("mean_ahead"), F.count(F.lit(1)).alias("n"), F.stddev_samp("ahead").alias("sd_ahead"))


def spread_test(fifths: DataFrame) -> DataFrame:
    """Top less bottom fifth, and Welch's t."""
    of = lambda c, k: F.max(F.when(F.col("fifth") == k, F.col(c)))
    top, low = of("mean_ahead", 5), of("mean_ahead", 1)
    error = F.sqrt(F.pow(of("sd_ahead", 5), 2) / of("n", 5) + F.pow(of("sd_ahead", 1), 2) / of("n", 1))
    return fifths.agg((top - low).alias("spread"), F.try_divide(top - low, error).alias("t"))


def feature_control(rows: DataFrame, x1: str, x2: str) -> DataFrame:
    """Least squares of ``ahead`` on two features alone and together, with t of the joint coefficients."""
    x, z, y = F.col(x1), F.col(x2), F.col("ahead")
    own_ = rows.where(x.isNotNull() & z.isNotNull() & y.isNotNull())
    m = own_.agg(F.count(F.lit(1)).alias("n"), correlation(x1, "ahead").alias("r1"), correlation(x2, "ahead").alias("r2"), F.var_pop(x).alias("xx"), F.var_pop(z).alias("zz"), F.covar_pop(x, z).alias("xz"), F.covar_pop(x, y).alias("xy"), F.covar_pop(z, y).alias("zy"), F.var_pop(y).alias("yy"))
    det = F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz")
    b1, b2 = F.try_divide(F.col("xy") * F.col("zz") - F.col("zy") * F.col("xz"), det), F.try_divide(F.col("zy") * F.col("xx") - F.col("xy") * F.col("xz"), det)
    rest = F.col("yy") - F.col("_b1") * F.col("xy") - F.col("_b2") * F.col("zy")
    m = m.withColumn("_b1", b1).withColumn("_b2", b2).withColumn("_s2", rest / (F.col("n") - 3)).withColumn("_det", det)
    t1, t2 = F.try_divide(F.col("_b1"), F.sqrt(F.col("_s2") * F.col("zz") / F.col("_det"))), F.try_divide(F.col("_b2"), F.sqrt(F.col("_s2") * F.col("xx") / F.col("_det")))
    return m.select("n", "r1", "r2", (F.col("xy") / F.col("xx")).alias("slope1"), (F.col("zy") / F.col("zz")).alias("slope2"), F.col("_b1").alias("joint1"), F.col("_b2").alias("joint2"), t1.alias("t1"), t2.alias("t2"))


def double_sort(rows: DataFrame, x1: str, x2: str) -> DataFrame:
    """Mean and count of ``ahead`` in fifths of one feature inside fifths of another."""
    own_ = with_tile(rows.where(f"{x1} IS NOT NULL AND {x2} IS NOT NULL AND ahead IS NOT NULL"), x1, "fifth1")
    own_ = with_tile(own_, x2, "fifth2", ("fifth1",))
    return own_.groupBy("fifth1", "fifth2").agg(F.avg("ahead").alias("mean_ahead"), F.count(F.lit(1)).alias("n"))


def conserved_groups(shares: DataFrame, split, groups: int = 3, most: int = 12, draws: int = 300, seed: int = 7) -> DataFrame:
    """grp, asset, side, weight, in_sample, out_sample, chance, holds: sets of assets whose shares of the flow add up to much the same.

    shares: asset, ts, share. Changes of the shares are standardised on each side of ``split``; a set's closure is the deviation of its sum
    over that of independent changes, a quadratic form of the correlation matrix. So Spark makes the two matrices over time, and one
    task grows sets from the most opposed pair while closure falls. A set holds if it closes better after the split than random sets of its size.
    Timestamps that not all assets have are left out, and so are assets that don't change."""
    n = shares.agg(F.count_distinct("asset").alias("_all"))
    full = shares.groupBy("ts").agg(F.count_distinct("asset").alias("_n")).join(F.broadcast(n)).where("_n = _all").select("ts")
    d = shares.join(full, "ts", "left_semi").withColumn("d", F.col("share") - F.lag("share").over(Window.partitionBy("asset").orderBy("ts"))).where("d IS NOT NULL").withColumn("late", (F.col("ts") >= F.lit(split)).cast("int"))
    x, y = d.select("ts", "late", F.col("asset").alias("a"), F.col("d").alias("da")), d.select("ts", F.col("asset").alias("b"), F.col("d").alias("db"))
    pairs = x.join(y, "ts").groupBy("late", "a", "b").agg(F.corr("da", "db").alias("r")).where(F.col("r").isNotNull() & ~F.isnan("r"))

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        columns = ["grp", "asset", "side", "weight", "in_sample", "out_sample", "chance", "holds"]
        names = sorted(set(part[part["late"] == 0]["a"]) & set(part[part["late"] == 1]["a"]))
        early, late = (part[part["late"] == k].pivot(index="a", columns="b", values="r").reindex(index=names, columns=names).to_numpy() for k in (0, 1))
        closure = lambda m, own_: float(np.sqrt(max(m[np.ix_(own_, own_)].sum(), 0.0) / len(own_)))
        rng, free, out = np.random.default_rng(seed), set(range(len(names))), []
        for g in range(1, groups + 1):
            opposed = [(early[i, j], i, j) for i in sorted(free) for j in sorted(free) if i < j]
            if not opposed:
                break
            own_ = list(min(opposed)[1:])
            while len(own_) < most and len(own_) < len(free):
                value, j = min((closure(early, [*own_, j]), j) for j in sorted(free - set(own_)))
                if value >= closure(early, own_):
                    break
                own_.append(j)
            if len(own_) < 3:
                break
            free -= set(own_)
            chance = float(np.mean([closure(late, list(rng.choice(len(names), len(own_), replace=False))) for _ in range(draws)]))
            _, vectors = np.linalg.eigh(early[np.ix_(own_, own_)])
            swing = vectors[:, -2] * (1 if vectors[np.argmax(np.abs(vectors[:, -2])), -2] > 0 else -1)
            inside, outside = closure(early, own_), closure(late, own_)
            out += [(g, names[j], int(np.sign(v)), abs(float(v)), inside, outside, chance, outside < 0.85 * chance) for j, v in zip(own_, swing, strict=True)]
        return pd.DataFrame(out, columns=columns)

    return pairs.groupBy(F.lit(1).alias("_one")).applyInPandas(grow, "grp int, asset string, side int, weight double, in_sample double, out_sample double, chance double, holds boolean")
