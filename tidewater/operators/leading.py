"""Leaders that are learned again on the way: pair statistics of a moving window, refreshed every so many steps of the market's calendar from
what lies before, and the signals that they give to forecasts made until the next refresh.

A refresh needs the correlations of all pairs at all lags over its window. Their moments are sums over time, so each pair's running sums are made
once and every window is a difference of two of them; a window's own edges are left out exactly. Assets are dealt to tiles of whole series: a task holds two
tiles and does all pairs between them, so that a series moves once for each tile and not once for each other asset.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Assets of a tile, about.
TILE = 32


def calendar(bars: DataFrame) -> DataFrame:
    """ts, t: the market's timestamps numbered from 0, one row a timestamp."""
    return bars.select("ts").distinct().select("ts", (F.row_number().over(Window.orderBy("ts")) - 1).alias("t"))


def _correlation(n, sx, sy, sxx, syy, sxy) -> np.ndarray:
    """Pearson's r from moments; 0 for under three points or without variance."""
    n_ = np.maximum(n, 1)
    spread = np.sqrt(np.maximum(0, sxx / n_ - (sx / n_) ** 2)) * np.sqrt(np.maximum(0, syy / n_ - (sy / n_) ** 2))
    return np.where((n >= 3) & (spread > 1e-18), (sxy / n_ - sx / n_ * sy / n_) / np.where(spread > 1e-18, spread, 1), 0.0)


def window_statistics(ta: np.ndarray, a: np.ndarray, tb: np.ndarray, b: np.ndarray, refreshes: np.ndarray, window: int, least: int, threshold: float, most: int):
    """n, r, lag and its r of two series (times and closes) for the window that ends with each refresh, of the points at which both have a value;
    r is that at once where it lies under the threshold, and the lag 0."""
    common, at_a, at_b = np.intersect1d(ta, tb, assume_unique=True, return_indices=True)
    first, end = np.searchsorted(common, np.maximum(0, refreshes - window)), np.searchsorted(common, refreshes, side="right")
    n = end - first
    out = np.zeros((len(refreshes), 3))
    if not (n >= least).any():
        return n, out
    x, y = (np.diff(np.log(v[i])) for v, i in ((a, at_a), (b, at_b)))  # the return at common point i + 1 is number i
    sums = [np.append(0, np.cumsum(v)) for v in (x, x * x, y, y * y)]
    total = lambda s, low, high: s[np.maximum(low, high)] - s[low]
    lags = np.arange(-most, most + 1)
    found = np.zeros((len(lags), len(refreshes)))
    last = np.maximum(first, end - 1)  # returns first .. end - 2
    for k, lag in enumerate(lags):
        shift = abs(lag)
        low, high = first, np.maximum(first, last - shift)
        products = np.append(0, np.cumsum(x[: len(x) - lag] * y[lag:] if lag >= 0 else y[: len(y) + lag] * x[-lag:]))
        clip = lambda i: np.minimum(i, len(products) - 1)
        ahead_low, ahead_high = np.minimum(low + shift, len(x)), np.minimum(high + shift, len(x))
        own_x, own_y = ((low, high), (ahead_low, ahead_high)) if lag >= 0 else ((ahead_low, ahead_high), (low, high))
        found[k] = _correlation(high - low, total(sums[0], *own_x), total(sums[2], *own_y), total(sums[1], *own_x), total(sums[3], *own_y), total(products, clip(low), clip(high)))
    now = found[most]
    best = np.argmax(np.round(np.abs(found), 9), axis=0)  # the most negative lag on a tie
    searched = np.abs(np.round(now, 9)) >= threshold
    out[:, 0] = now
    out[:, 1] = np.where(searched, lags[best], 0)
    out[:, 2] = np.where(searched, found[best, np.arange(len(refreshes))], now)
    return n, out


def pair_refreshes(bars: DataFrame, history: int = 60, every: int = 60, window: int = 500, least: int = 60, threshold: float = 0.15, most: int = 12, tile: int = TILE) -> DataFrame:
    """refresh (t of the calendar), a, b, n, corr0, lag, lag_corr of all pairs a < b: their statistics over the last ``window`` steps at history,
    history + every, ... Only bars at or before a refresh count. Pairs with under ``least`` common points have no row."""
    rows = bars.where("close > 0").join(calendar(bars), "ts")
    last = rows.agg(F.max("t").alias("_last"), F.count_distinct("asset").alias("_n")).first()  # two numbers
    refreshes = np.arange(history, (last["_last"] or 0) + 1, every)
    tiles = max(1, -(-last["_n"] // tile))
    series = rows.groupBy("asset").agg(F.array_sort(F.collect_list(F.struct("t", "close"))).alias("_s"))
    series = series.select("asset", F.transform("_s", lambda p: p["t"]).alias("t"), F.transform("_s", lambda p: p["close"]).alias("close"), F.pmod(F.xxhash64("asset"), F.lit(tiles)).cast("int").alias("_tile"))
    left = series.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    pairs = left.select("asset", "t", "close", F.least("_tile", "_other").alias("_low"), F.greatest("_tile", "_other").alias("_high"), "_tile")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        low, high, out = int(part["_low"].iloc[0]), int(part["_high"].iloc[0]), []
        own_ = [(a, np.asarray(t), np.asarray(c, float), k) for a, t, c, k in zip(part["asset"], part["t"], part["close"], part["_tile"], strict=True)]
        for i, (a, ta, ca, ka) in enumerate(own_):
            for b, tb, cb, kb in own_[:i]:
                if low == high or ka != kb:  # pairs within a tile belong to the tile's own group
                    (u, tu, cu), (v, tv, cv) = sorted([(a, ta, ca), (b, tb, cb)], key=lambda s: s[0])
                    n, found = window_statistics(tu, cu, tv, cv, refreshes, window, least, threshold, most)
                    for k in np.flatnonzero(n >= least):
                        out.append((int(refreshes[k]), u, v, int(n[k]), *found[k]))
        return pd.DataFrame(out, columns=["refresh", "a", "b", "n", "corr0", "lag", "lag_corr"]).astype({"lag": int})

    return pairs.groupBy("_low", "_high").applyInPandas(run, "refresh int, a string, b string, n int, corr0 double, lag int, lag_corr double")


def lead_signals(pairs: DataFrame, bars: DataFrame, top: int = 5) -> DataFrame:
    """refresh, asset, leader, lag, lag_corr, recent: the ``top`` leaders of each asset by |lag_corr|, and what each moved over the last ``lag`` of its own bars at or
    before the refresh."""
    ahead = pairs.where("lag <> 0").select("refresh", F.when(F.col("lag") > 0, F.col("b")).otherwise(F.col("a")).alias("asset"), F.when(F.col("lag") > 0, F.col("a")).otherwise(F.col("b")).alias("leader"), F.abs("lag").alias("lag"), F.round("lag_corr", 6).alias("lag_corr"))
    place = Window.partitionBy("refresh", "asset").orderBy(F.desc(F.abs("lag_corr")), "leader")
    led = ahead.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= top).drop("_n")
    rows = bars.where("close > 0").join(calendar(bars), "ts")
    numbered = rows.select(F.col("asset").alias("leader"), "t", F.ln("close").alias("x"), F.row_number().over(Window.partitionBy("asset").orderBy("t")).alias("i"))
    # the leader's last bar at or before each refresh: both sides in one window, in order of time
    asked = led.select("leader", F.col("refresh").alias("t")).distinct().select("leader", "t", F.lit(None).cast("double").alias("x"), F.lit(None).cast("int").alias("i"), F.lit(True).alias("asks"))
    both = numbered.withColumn("asks", F.lit(False)).unionByName(asked)
    upto = Window.partitionBy("leader").orderBy("t", "asks").rowsBetween(Window.unboundedPreceding, 0)
    last = both.withColumn("_i", F.last("i", ignorenulls=True).over(upto)).where("asks").select("leader", F.col("t").alias("refresh"), "_i")
    met = led.join(last, ["leader", "refresh"])
    met = met.withColumn("_before", F.greatest(F.lit(1), F.col("_i") - F.col("lag")))
    for at, x in (("_i", "_xa"), ("_before", "_xb")):
        met = met.join(numbered.select("leader", F.col("i").alias(at), F.col("x").alias(x)), ["leader", at])
    return met.select("refresh", "asset", "leader", "lag", "lag_corr", (F.col("_xa") - F.col("_xb")).alias("recent"))


def lead_predictions(signals: DataFrame, horizons: tuple[int, ...], least: float = 0.3) -> DataFrame:
    """refresh, asset, h, leadlag: the leaders' last moves weighed by |lag_corr|, of those that reach ``least`` and lead by the horizon or more."""
    each = signals.where(F.abs("lag_corr") >= least).withColumn("h", F.explode(F.array(*map(F.lit, horizons)))).where(F.col("lag") >= F.col("h"))
    w = F.abs("lag_corr")
    return each.groupBy("refresh", "asset", "h").agg((F.sum(w * F.col("recent")) / F.sum(w)).alias("leadlag"))


def with_leaders(made: DataFrame, predictions: DataFrame, steps: DataFrame, history: int = 60, every: int = 60) -> DataFrame:
    """made (asset, ts, h, ...) with leadlag: the prediction of the newest refresh at or before each forecast, 0 where there is none."""
    rows = made.join(steps, "ts").withColumn("refresh", F.when(F.col("t") >= history, F.col("t") - (F.col("t") - history) % every))
    return rows.join(predictions, ["asset", "h", "refresh"], "left").withColumn("leadlag", F.coalesce("leadlag", F.lit(0.0))).drop("refresh", "t")


FIVE = ("naive", "drift", "momentum", "meanrev", "leadlag")


def walk_passes(made: DataFrame, models: tuple[str, ...] = FIVE, history: int = 60, eta: float = 0.5, floor: float = 0.01, penalty: float = 1.2) -> DataFrame:
    """made (pass, asset, hours, ts, rn, h, close, target_ts, actual_close and a prediction a model) with combined and after.

    Passes follow one another: a forecast is mixed by the weights that the forecasts arrived by then had taught, those of all
    earlier passes included, and a pass goes on from where the one before it ended. Forecasts are made from ``history`` bars on and
    where their target exists. after holds the weights of the models when all has arrived, in the last row of an asset and horizon (hours), else null."""
    columns = ["pass", "asset", "hours", "ts", "rn", "h", "close", "target_ts", "actual_close"]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        w, done = np.full(len(models), 1.0 / len(models)), []
        for _, rows in part.sort_values(["pass", "rn"]).groupby("pass"):
            p, actual = rows[list(models)].to_numpy(), np.log(rows["actual_close"] / rows["close"]).to_numpy()[:, None]
            loss = np.minimum(4.0, np.abs(p - actual) / np.maximum(0.002, 2 * np.abs(actual)))
            loss += penalty * ((np.abs(actual) > 1e-5) & ((np.abs(p) < 1e-4) | (np.sign(p) != np.sign(actual))))
            steps = np.empty((len(rows) + 1, len(models)))
            steps[0] = w
            for i, by in enumerate(np.exp(-eta * loss)):
                now = steps[i] * by
                now = np.maximum(floor, now / now.sum())
                steps[i + 1] = now / now.sum()
            made_at = rows["rn"].to_numpy()
            arrived = np.searchsorted(made_at + rows["h"].to_numpy(), made_at, side="right")
            done.append(rows[columns].assign(combined=(steps[arrived] * np.clip(p, -0.5, 0.5)).sum(axis=1)))
            w = steps[-1]
        out = pd.concat(done)
        out["after"] = [None] * (len(out) - 1) + [w.tolist()]
        return out

    rows = made.where((F.col("rn") > history) & F.col("actual_close").isNotNull()).select(*columns, *models)
    schema = "pass int, asset string, hours int, ts timestamp, rn int, h int, close double, target_ts timestamp, actual_close double, combined double, after array<double>"
    return rows.groupBy("asset", "hours").applyInPandas(run, schema)


def learned(walked: DataFrame, models: tuple[str, ...] = FIVE) -> DataFrame:
    """asset, hours, model, weight at the end of a walk."""
    each = walked.where("after IS NOT NULL").select("asset", "hours", F.posexplode("after").alias("_k", "weight"))
    return each.select("asset", "hours", F.element_at(F.array(*map(F.lit, models)), F.col("_k") + 1).alias("model"), "weight")


def pass_summary(scores: DataFrame, by: tuple[str, ...] = ("pass", "hours")) -> DataFrame:
    """by, n, mean_error, hit_rate of scored forecasts."""
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("abs_pct_error").alias("mean_error"), F.avg(F.col("hit").cast("double")).alias("hit_rate"))
