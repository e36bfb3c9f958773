"""Spectra, cycles and regimes. Spark cuts the series into segments and groups what belongs together; tasks transform whole segments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.series import own


def detrended(bars: DataFrame) -> DataFrame:
    """asset, ts, i, x: log price less its least-squares line."""
    rows = bars.where("close > 0").withColumn("i", F.row_number().over(own()) - 1).withColumn("_x", F.ln("close"))
    line = rows.groupBy("asset").agg(F.regr_slope("_x", "i").alias("_b"), F.regr_intercept("_x", "i").alias("_a"))
    return rows.join(line, "asset").select("asset", "ts", F.col("i").cast("long").alias("i"), (F.col("_x") - F.col("_a") - F.col("_b") * F.col("i")).alias("x"))


def fourier(series: DataFrame, frequencies: range, segment: int) -> DataFrame:
    """asset, seg, k, re, im of half-overlapping Hann-weighed segments without their mean.

    A segment's points are gathered first, so that a row is a whole segment and its transform one matrix product."""
    half = segment // 2
    rows = series.withColumn("_first", F.floor(F.col("i") / half)).withColumn("seg", F.explode(F.array(F.col("_first") - 1, F.col("_first")))).where("seg >= 0")
    whole = rows.groupBy("asset", "seg").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("_s")).where(F.size("_s") == segment)
    j = np.arange(segment)
    w = 0.5 - 0.5 * np.cos(2 * np.pi * j / (segment - 1))
    k = np.array(frequencies)
    wave = np.exp(2j * np.pi * np.outer(j, k) / (4 * segment)) * (w / np.sqrt((w * w).sum()))[:, None]

    def run(batches):
        for part in batches:
            if len(part):
                x = np.stack(part["x"].to_numpy()).astype(float)
                z = (x - x.mean(axis=1, keepdims=True)) @ wave
                at = np.repeat(np.arange(len(part)), len(k))
                yield pd.DataFrame({"asset": part["asset"].to_numpy()[at], "seg": part["seg"].to_numpy()[at], "k": np.tile(k, len(part)), "re": z.real.ravel(), "im": z.imag.ravel()})

    return whole.select("asset", "seg", F.col("_s.x").alias("x")).mapInPandas(run, "asset string, seg long, k int, re double, im double")


def welch(transformed: DataFrame) -> DataFrame:
    """asset, k, power: the mean over the segments."""
    return transformed.groupBy("asset", "k").agg(F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))


def summary(power: DataFrame, segment: int, ring: int = 12) -> DataFrame:
    """Each asset's entropy, dominant period, and prominence over the median of the ring around the peak."""
    w = Window.partitionBy("asset")
    rows = power.withColumn("_p", F.col("power") / F.sum("power").over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
    around = Window.partitionBy("asset").orderBy("k").rowsBetween(-ring, ring)
    rows = rows.withColumn("_ring", F.percentile("power", F.lit(0.5)).over(around))
    peak = F.max_by(F.struct("k", "power", "_ring"), F.struct("power", -F.col("k")))
    own_ = rows.groupBy("asset").agg((-F.sum(F.when(F.col("_p") > 0, F.col("_p") * F.ln("_p")).otherwise(0.0)) / F.ln(F.max("_n"))).alias("entropy"), peak.alias("_b"))
    return own_.select("asset", "entropy", (4.0 * segment / F.col("_b.k")).alias("period"), F.try_divide(F.col("_b.power"), F.col("_b._ring")).alias("prominence"))


def coherence(transformed: DataFrame) -> DataFrame:
    """a, b, k, coherence, phase: cross-spectra of all pairs, averaged over the common segments."""
    x, y = transformed.select(F.col("asset").alias("a"), "seg", "k", F.col("re").alias("ra"), F.col("im").alias("ia")), transformed.select(F.col("asset").alias("b"), "seg", "k", F.col("re").alias("rb"), F.col("im").alias("ib"))
    met = x.join(y, ["seg", "k"]).where("a < b")
    sums = met.groupBy("a", "b", "k").agg(F.avg(F.expr("ra * rb + ia * ib")).alias("_re"), F.avg(F.expr("ia * rb - ra * ib")).alias("_im"), F.avg(F.expr("ra * ra + ia * ia")).alias("_pa"), F.avg(F.expr("rb * rb + ib * ib")).alias("_pb"), F.count(F.lit(1)).alias("segments"))
    return sums.select("a", "b", "k", "segments", F.try_divide(F.expr("_re * _re + _im * _im"), F.col("_pa") * F.col("_pb")).alias("coherence"), F.atan2("_im", "_re").alias("phase"))


def hurst(returns: DataFrame, least_box: int = 8) -> DataFrame:
    """asset, hurst, r2, label, confidence by detrended fluctuation: the profile's residual in boxes of growing size, on log scales.

    returns: asset, ts, r. Each box's regression is a moment sum, so boxes are groups of one aggregate."""
    w = own()
    rows = returns.withColumn("i", (F.row_number().over(w) - 1).cast("long")).withColumn("_m", F.avg("r").over(Window.partitionBy("asset"))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("asset")))
    rows = rows.withColumn("y", F.sum(F.col("r") - F.col("_m")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sizes, box = [], float(least_box)
    while box < 1e6:
        sizes.append(int(box))
        box *= 1.35
    each = rows.withColumn("box", F.explode(F.array(*[F.lit(s) for s in sizes]))).where(F.col("box") <= F.col("_n") / 4)
    each = each.withColumn("_k", F.floor(F.col("i") / F.col("box"))).where((F.col("_k") + 1) * F.col("box") <= F.col("_n"))
    boxes = each.groupBy("asset", "box", "_k").agg(F.regr_syy("y", "i").alias("_syy"), F.regr_sxy("y", "i").alias("_sxy"), F.regr_sxx("y", "i").alias("_sxx"))
    rest = F.greatest(F.col("_syy") - F.try_divide(F.col("_sxy") * F.col("_sxy"), F.col("_sxx")), F.lit(0.0))
    scales = boxes.groupBy("asset", "box").agg(F.sqrt(F.sum(rest) / (F.count(F.lit(1)) * F.col("box"))).alias("_f")).where("_f > 0").select("asset", F.ln("box").alias("lx"), F.ln("_f").alias("ly"))
    fit = scales.groupBy("asset").agg(F.regr_slope("ly", "lx").alias("_h"), F.regr_r2("ly", "lx").alias("r2"), F.count(F.lit(1)).alias("_c")).where("_c >= 4")
    h = F.greatest(F.lit(0.0), F.least(F.lit(1.2), F.col("_h")))
    return fit.select("asset", h.alias("hurst"), "r2", F.when(h > 0.55, "trending").when(h < 0.45, "reverting").otherwise("random").alias("label"), (F.least(F.lit(1.0), F.abs(h - 0.5) / 0.25) * F.col("r2")).alias("confidence"))


def regime_prior(regimes: DataFrame) -> DataFrame:
    """asset, model, weight: trending series lean to momentum and drift, reverting ones to the mean, by confidence; the weights
    add up to 1, or are all 1 without confidence. regimes: see hurst."""
    k = 1 + 0.5 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("confidence")))
    trending, reverting, one = F.col("label") == "trending", F.col("label") == "reverting", F.lit(1.0)
    raw = {"naive": one, "drift": F.when(trending, k).otherwise(one), "momentum": F.when(trending, k).when(reverting, 1 / k).otherwise(one), "meanrev": F.when(trending, 1 / k).when(reverting, k).otherwise(one), "leadlag": one}
    each = F.array(*[F.struct(F.lit(m).alias("model"), v.alias("weight")) for m, v in raw.items()])
    total = F.when(F.col("confidence") > 0, F.aggregate("_w", F.lit(0.0), lambda a, x: a + x["weight"])).otherwise(1.0)
    return regimes.withColumn("_w", each).withColumn("_t", total).select("asset", "_t", F.explode("_w").alias("_m")).select("asset", "_m.model", (F.col("_m.weight") / F.col("_t")).alias("weight"))


def band_pass(bars: DataFrame, shortest: float = 5.0, longest: float = 120.0) -> DataFrame:
    """asset, ts, band: log price between two exponential means, a fast one that drops what is shorter than the band and a slow one
    that drops what is longer. The run-in is left out where enough remains; series under 8 bars give nothing."""
    fast, slow = 2 / (max(2.0, shortest / 2) + 1), 2 / (max(4.0, longest * 1.2) + 1)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ts")
        n, y = len(part), np.log(part["close"])
        warm = min(n // 4, int(2 * longest))
        out = part[["asset", "ts"]].assign(band=y.ewm(alpha=fast, adjust=False).mean() - y.ewm(alpha=slow, adjust=False).mean())
        return out.iloc[warm if n - warm > 32 else 0 :] if n >= 8 else out.iloc[:0]

    return bars.where("close > 0").select("asset", "ts", "close").groupBy("asset").applyInPandas(run, "asset string, ts timestamp, band double")


def cycle_stability(transformed: DataFrame, segment: int, segments: int = 7, near: float = 0.2, least: float = 4.0) -> DataFrame:
    """asset, windows, stability, period, deviation, prominence: in how many rolling windows of ``segments`` half-overlapping segments
    the strongest period lies near the median one. A window whose peak doesn't stand out counts as a miss.

    transformed: see fourier; windows share its segments, so each is transformed once."""
    rolling = transformed.withColumn("_w", F.explode(F.sequence(F.greatest(F.lit(0), F.col("seg") - (segments - 1)), F.col("seg"))))
    power = rolling.groupBy(F.struct("asset", "_w").alias("asset"), "k").agg(F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"), F.count(F.lit(1)).alias("_n"))
    peaks = summary(power.where(F.col("_n") == segments).drop("_n"), segment).select("asset.asset", F.when(F.col("prominence") >= least, F.col("period")).alias("p"), "prominence")
    middle = peaks.groupBy("asset").agg(F.percentile("p", F.lit(0.5)).alias("_m"), F.percentile("prominence", F.lit(0.5)).alias("prominence"))
    met = peaks.select("asset", "p").join(middle, "asset")
    off = F.abs(F.col("p") - F.col("_m"))
    own_ = met.groupBy("asset", "_m", "prominence").agg(F.count(F.lit(1)).alias("windows"), F.avg(F.when(off / F.col("_m") <= near, 1.0).otherwise(0.0)).alias("stability"), F.avg(off).alias("deviation"))
    return own_.select("asset", "windows", "stability", F.coalesce("_m", F.lit(0.0)).alias("period"), F.coalesce("deviation", F.lit(0.0)).alias("deviation"), "prominence")


def ssa_forecast(x: np.ndarray, window: int, components: int, ahead: int) -> tuple[np.ndarray, float]:
    """Continuation of a series by its leading oscillations, and the share of variance they hold."""
    centred = x - x.mean()
    n = len(x)
    rows = np.lib.stride_tricks.sliding_window_view(centred, window)
    values, vectors = np.linalg.eigh(rows.T @ rows / len(rows))
    lead = vectors[:, ::-1][:, :components]
    share = float(values[::-1][:components].sum() / max(values.sum(), 1e-300))
    parts = rows @ lead @ lead.T
    smooth = np.zeros(n)
    count = np.zeros(n)
    for j in range(window):
        smooth[j : j + len(rows)] += parts[:, j]
        count[j : j + len(rows)] += 1
    smooth /= count
    last = lead[-1]
    nu = float((last**2).sum())
    if nu >= 0.999:
        return np.full(ahead, x.mean() + smooth[-1]), share
    weights = lead[:-1] @ last / (1 - nu)
    path = list(smooth[-(window - 1) :])
    for _ in range(ahead):
        path.append(float(np.dot(weights, path[-(window - 1) :])))
    return x.mean() + np.array(path[window - 1 :]), share


def ssa(bars: DataFrame, tail: int = 400, components: int = 4, ahead: int = 20) -> DataFrame:
    """asset, step, predicted, share: the log price ``ahead`` bars on, by singular-spectrum analysis of each asset's tail.
    Spark cuts the tails; an eigenproblem of bounded size is solved for each asset."""
    order = Window.partitionBy("asset").orderBy(F.desc("ts"))
    rows = bars.where("close > 0").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= tail).select("asset", "_n", F.ln("close").alias("x"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = part.sort_values("_n", ascending=False)["x"].to_numpy()
        if len(x) < 40:
            return pd.DataFrame([], columns=["asset", "step", "predicted", "share"])
        path, share = ssa_forecast(x, len(x) // 4, components, ahead)
        return pd.DataFrame({"asset": part["asset"].iloc[0], "step": np.arange(1, ahead + 1), "predicted": path, "share": share})

    return rows.groupBy("asset").applyInPandas(run, "asset string, step int, predicted double, share double")


def instant_cycle(band: DataFrame, shortest: float = 6.0, longest: float = 120.0, lookback: int = 20) -> DataFrame:
    """asset, phase (degrees), amplitude, period, quality at the end of each band-passed series (asset, ts, band), by the homodyne
    discriminator: the turn between one analytic value and the next is the phase gained a bar. Quality is how still the period
    lay of late. Series under 64 bars or without a period in the band are left out."""

    def quadrature(x: list[float]) -> float:
        return 0.0962 * (x[-1] - x[-7]) + 0.5769 * (x[-3] - x[-5])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = part.sort_values("ts")["band"].to_numpy()
        none = pd.DataFrame([], columns=["asset", "phase", "amplitude", "period", "quality"])
        if len(x) < 64:
            return none
        smooth = np.convolve(x, [0.4, 0.3, 0.2, 0.1])[: len(x)]
        smooth[:3] = 0
        detrended, in_phase, quadratures = [0.0] * 6, [0.0] * 6, [0.0] * 6
        period, shown, pointer, product = (shortest + longest) / 2, [], 0j, 0j
        for i in range(6, len(x)):
            gain = 0.075 * period + 0.54
            detrended.append(quadrature([*smooth[i - 6 : i + 1]]) * gain)
            in_phase.append(detrended[-4])
            quadratures.append(quadrature(detrended) * gain)
            turned = complex(in_phase[-1] - quadrature(quadratures) * gain, quadratures[-1] + quadrature(in_phase) * gain)
            now = 0.2 * turned + 0.8 * pointer
            product = 0.2 * now.conjugate() * pointer + 0.8 * product
            pointer = now
            turn = abs(np.angle(product)) if product.real and product.imag else 0.0
            found = 2 * np.pi / turn if turn > 1e-9 else period
            found = min(max(found, 0.67 * period), 1.5 * period)
            period = 0.2 * min(max(found, shortest), longest) + 0.8 * period
            shown.append(0.33 * period + 0.67 * (shown[-1] if shown else period))
        length, late = shown[-1], np.array(shown[-(lookback + 1) :])
        span = min(round(length), len(x) - 7)
        if not shortest <= length <= longest or span < 4:
            return none
        quality = min(1.0, max(0.0, 1 - 4 * np.abs(late - late.mean()).mean() / late.mean()))
        last, angle = smooth[::-1][:span], 2 * np.pi * np.arange(span) / length
        phase = np.degrees(np.arctan2((np.cos(angle) * last).sum(), (np.sin(angle) * last).sum())) % 360
        return pd.DataFrame({"asset": part["asset"].iloc[:1], "phase": phase, "amplitude": np.sqrt(2 * (last**2).mean()), "period": length, "quality": quality})

    return band.groupBy("asset").applyInPandas(run, "asset string, phase double, amplitude double, period double, quality double").where("quality > 0")


def cycle_projection(states: DataFrame, ahead: int, half_life: float = 20.0) -> DataFrame:
    """asset, step, projected: the cycle goes on in phase while its amplitude, scaled by quality, halves every so many bars."""
    rows = states.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(ahead))))
    decay, angle = F.pow(F.lit(0.5), F.col("step") / max(1.0, half_life)), F.radians("phase") + 2 * np.pi / F.col("period") * F.col("step")
    return rows.select("asset", "step", (F.col("amplitude") * F.col("quality") * decay * F.cos(angle)).alias("projected"))


def frequency_patterns(series: DataFrame, transformed: DataFrame, segment: int, segments: int = 15, every: int = 4, peaks: int = 5, least_prominence: float = 4.0, least_stability: float = 0.5) -> DataFrame:
    """asset, epoch, period, prominence, stability, phase, amplitude: the strongest peaks of each epoch of ``segments`` segments, one epoch
    every ``every`` segments. Peaks are measured against the ring around them and lie at least 15 % apart; stability is that of
    the epoch's rolling windows. Phase and amplitude are those at the epoch's end, projected over the whole epoch.

    series: asset, i, x; transformed: see fourier."""
    first = F.sequence(F.greatest(F.lit(0), F.ceil((F.col("seg") - (segments - 1)) / every)), F.floor(F.col("seg") / every))
    dealt = transformed.where(F.floor(F.col("seg") / every) >= F.greatest(F.lit(0), F.ceil((F.col("seg") - (segments - 1)) / every))).withColumn("epoch", F.explode(first))
    key = F.struct("asset", "epoch").alias("asset")
    power = dealt.groupBy(key, "k").agg(F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == segments).drop("_n")
    ring = F.percentile("power", F.lit(0.5)).over(Window.partitionBy("asset").orderBy("k").rowsBetween(-12, 12))
    ratios = power.withColumn("ratio", F.try_divide(F.col("power"), ring)).select("asset.asset", "asset.epoch", "k", "ratio")

    def pick(part: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[float, float]] = []
        for k, ratio in part.sort_values(["ratio", "k"], ascending=[False, True])[["k", "ratio"]].itertuples(index=False):
            period = 4.0 * segment / k
            if len(kept) < peaks and all(abs(p - period) / period >= 0.15 for p, _ in kept):
                kept.append((period, ratio))
        return pd.DataFrame([(part["asset"].iloc[0], part["epoch"].iloc[0], p, r) for p, r in kept], columns=["asset", "epoch", "period", "prominence"])

    found = ratios.groupBy("asset", "epoch").applyInPandas(pick, "asset string, epoch long, period double, prominence double").where(F.col("prominence") >= least_prominence)
    windows = dealt.where(F.col("seg") - F.col("epoch") * every <= segments - 1).select(F.to_json(F.struct("asset", "epoch")).alias("asset"), (F.col("seg") - F.col("epoch") * every).alias("seg"), "k", "re", "im")
    still = cycle_stability(windows, segment).select(F.from_json("asset", "asset string, epoch long").alias("_a"), "stability").select("_a.*", "stability").where(F.col("stability") >= least_stability)
    half, length = segment // 2, (segments + 1) * segment // 2
    met = found.join(still, ["asset", "epoch"]).withColumn("_from", F.col("epoch") * every * half)
    at = met.withColumn("i", F.explode(F.sequence(F.col("_from"), F.col("_from") + length - 1))).join(series.select("asset", "i", "x"), ["asset", "i"])
    angle = 2 * np.pi / F.col("period") * (F.col("i") - F.col("_from") - (length - 1))
    sums = at.groupBy("asset", "epoch", "period", "prominence", "stability").agg(F.sum(F.col("x") * F.cos(angle)).alias("_c"), F.sum(F.col("x") * F.sin(angle)).alias("_s"))
    return sums.select("asset", "epoch", "period", "prominence", "stability", F.pmod(F.degrees(F.atan2(-F.col("_s"), F.col("_c"))), F.lit(360.0)).alias("phase"), (2 * F.sqrt(F.col("_c") * F.col("_c") + F.col("_s") * F.col("_s")) / length).alias("amplitude"))


def phase_projection(series: DataFrame, periods: tuple[int, ...]) -> DataFrame:
    """asset, period, phase (degrees), amplitude: each series (asset, i, x) projected on cosine and sine of given periods, counted back from its end."""
    last = F.max("i").over(Window.partitionBy("asset"))
    rows = series.withColumn("_t", F.col("i") - last).withColumn("period", F.explode(F.array(*map(F.lit, periods))))
    angle = 2 * np.pi / F.col("period") * F.col("_t")
    sums = rows.groupBy("asset", "period").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col("x") * F.cos(angle)).alias("_c"), F.sum(F.col("x") * F.sin(angle)).alias("_s"))
    return sums.select("asset", "period", F.pmod(F.degrees(F.atan2(-F.col("_s"), F.col("_c"))), F.lit(360.0)).alias("phase"), (2 * F.sqrt(F.col("_c") * F.col("_c") + F.col("_s") * F.col("_s")) / F.col("_n")).alias("amplitude"))


def match_patterns(patterns: DataFrame, tolerance: float = 0.12, least: float = 0.3) -> DataFrame:
    """epoch, a, b, period_a, period_b, delta, phase_delta, lag, score of patterns of two assets in one epoch with periods within the
    tolerance; lag is in bars, from the one with the shorter period. Periods meet by buckets of their logarithm."""
    width = float(np.log1p(tolerance))
    x = patterns.withColumn("_k", F.floor(F.ln("period") / width))
    p, q = x.select("epoch", F.explode(F.array(F.col("_k"), F.col("_k") + 1)).alias("_k"), F.struct("period", "asset", "prominence", "stability", "phase").alias("p")), x.select("epoch", "_k", F.struct("period", "asset", "prominence", "stability", "phase").alias("q"))
    met = p.join(q, ["epoch", "_k"]).where("p.asset <> q.asset AND (p.period < q.period OR (p.period = q.period AND p.asset < q.asset))")
    met = met.withColumn("delta", (F.col("q.period") - F.col("p.period")) / F.col("p.period")).where(F.col("delta") <= tolerance)
    score = 0.3 * (1 - F.col("delta") / tolerance) + 0.4 * F.least("p.stability", "q.stability") + 0.3 * F.least(F.lit(1.0), F.least("p.prominence", "q.prominence") / 12)
    turn = F.pmod(F.col("q.phase") - F.col("p.phase") + 180, F.lit(360.0)) - 180
    first = F.col("p.asset") < F.col("q.asset")
    pair = [F.when(first, F.col(f"{u}.{c}")).otherwise(F.col(f"{v}.{c}")).alias(n) for u, v, c, n in (("p", "q", "asset", "a"), ("q", "p", "asset", "b"), ("p", "q", "period", "period_a"), ("q", "p", "period", "period_b"))]
    return met.select("epoch", *pair, "delta", turn.alias("phase_delta"), (turn / 360 * (F.col("p.period") + F.col("q.period")) / 2).alias("lag"), score.alias("score")).where(F.col("score") >= least)


def recurring_pairs(matches: DataFrame, least: int = 3) -> DataFrame:
    """a, b, epochs, mean_period, mean_lag, lag_sd, mean_score of the pairs that match in at least so many epochs."""
    lag = F.when(F.col("lag") != 0, F.col("lag"))
    rows = matches.groupBy("a", "b").agg(
        F.count_distinct("epoch").alias("epochs"), F.avg((F.col("period_a") + F.col("period_b")) / 2).alias("mean_period"), F.coalesce(F.avg(lag), F.lit(0.0)).alias("mean_lag"),
        F.coalesce(F.stddev_samp(lag), F.lit(0.0)).alias("lag_sd"), F.avg("score").alias("mean_score"),
    )
    return rows.where(F.col("epochs") >= least)
