"""Path forecasts from spectra, each trusted by how well it did on bars that were held back: singular spectra, instant cycles, their mixture, and
the search for their parameters.

Spark cuts every series at its cut points, so that a row is a whole training series; a task solves one bounded eigenproblem for it and
scores all configurations on it, so a series moves once and not once for each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spectral import band_pass, cycle_projection, cycle_stability, detrended, fourier, instant_cycle, ssa_forecast

PATH = "array<double>"


def log_tails(bars: DataFrame, tail: int) -> DataFrame:
    """asset, x: the log closes of each asset's last ``tail`` bars, in order. Series with a price that isn't positive are left out."""
    back = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("ts")))
    rows = bars.select("asset", "ts", "close", back.alias("_back")).where(F.col("_back") <= tail)
    sound = rows.groupBy("asset").agg(F.min("close").alias("_least"), F.array_sort(F.collect_list(F.struct("ts", "close"))).alias("_s")).where(F.col("_least") > 0)
    return sound.select("asset", F.transform("_s", lambda p: F.ln(p["close"])).alias("x"))


def holdout_skill(path: np.ndarray | None, truth: np.ndarray, base: float) -> float:
    """How much closer than standing still a path came, 0 to 1; 0 without a path or a move."""
    still = np.abs(base - truth).sum()
    if path is None or len(path) < len(truth) or still <= 0:
        return 0.0
    return float(min(1.0, max(0.0, 1 - np.abs(path[: len(truth)] - truth).sum() / still)))


def spread_of(x: np.ndarray) -> float:
    sd = np.diff(x).std(ddof=1) if len(x) > 2 else 0.0
    return float(sd) if sd > 1e-9 else 0.02


def math_forecast(bars: DataFrame, horizons: tuple[int, ...], tail: int = 400, components: int = 4, held: int = 40) -> DataFrame:
    """asset, h, skill, share, value: the log return that the singular spectrum of an asset's last ``tail`` bars leads to.

    skill is measured on ``held`` bars that the training didn't see. value is null without skill, beyond the bars tested or the window, and where it
    passes three times the usual spread over the way. Assets with fewer than 120 bars give no row."""
    schema = f"asset string, skill double, share double, spread double, base double, path {PATH}"

    def run(batches):
        for batch in batches:
            rows = []
            for asset, values in zip(batch["asset"], batch["x"], strict=True):
                x = np.asarray(values, float)
                window = min(120, max(12, len(x) // 4))
                train = x[:-held]
                trial, _ = ssa_forecast(train, min(window, len(train) // 2), components, held)
                skill, path, share = holdout_skill(trial, x[-held:], train[-1]), [], 0.0
                if skill > 0:
                    found, share = ssa_forecast(x, window, components, min(max(horizons), window))
                    path = found.tolist()
                rows.append((asset, skill, share, spread_of(x), x[-1], path))
            yield pd.DataFrame(rows, columns=["asset", "skill", "share", "spread", "base", "path"])

    found = log_tails(bars, tail).where(F.size("x") >= 120).mapInPandas(run, schema)
    each = found.withColumn("h", F.explode(F.array(*map(F.lit, horizons))))
    value = F.get("path", F.col("h") - 1) - F.col("base")
    kept = F.when((F.col("h") <= held) & (F.abs(value) <= 3 * F.col("spread") * F.sqrt("h")), value)
    return each.select("asset", "h", "skill", "share", kept.alias("value"))


def cycle_paths(bars: DataFrame, ahead: int, longest: float, half_life: float) -> DataFrame:
    """asset, path: the instant cycle of each band-passed series carried on, as a deviation from the last price."""
    states = instant_cycle(band_pass(bars, 4.0, 2.5 * longest), longest=longest)
    steps = cycle_projection(states, ahead, half_life)
    return steps.groupBy("asset").agg(F.array_sort(F.collect_list(F.struct("step", "projected"))).alias("_p")).select("asset", F.transform("_p", lambda p: p["projected"]).alias("path"))


def combined_forecast(
    bars: DataFrame, ahead: int = 30, components: int = 4, longest: float = 120.0, half_life: float = 20.0, tail: int = 750, segment: int = 128, gate: bool = True,
) -> DataFrame:
    """asset, step, value, ssa, cycle, stability, ssa_weight, cycle_weight: the mixture of both paths, in log return from the last close.

    Each path is weighed by its skill on as many held bars as are forecast (10 to a fifth of the series), made from what lay before them. The cycle's
    skill and path shrink with the stability of the cycle, if gated. Series of under 120 bars give nothing; where no path has skill, no row comes."""
    back = F.row_number().over(Window.partitionBy("asset").orderBy(F.desc("ts"))) - 1
    rows = bars.where("close > 0").select("asset", "ts", "close", back.alias("_back")).where(F.col("_back") < tail)
    sizes = rows.groupBy("asset").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 120")
    rows = rows.join(sizes, "asset").withColumn("_held", F.greatest(F.lit(10), F.least(F.lit(ahead), F.floor(F.col("_n") / 5)).cast("int")))
    train = rows.where(F.col("_back") >= F.col("_held"))
    most = max(10, ahead)

    stable = cycle_stability(fourier(detrended(rows.select("asset", "ts", "close")), range(5, 4 * segment // 5), segment), segment).select("asset", "stability")
    cycle_now = cycle_paths(rows.select("asset", "ts", "close"), ahead, longest, half_life).withColumnRenamed("path", "cycle_path")
    cycle_then = cycle_paths(train.select("asset", "ts", "close"), most, longest, half_life).withColumnRenamed("path", "cycle_trial")
    series = rows.groupBy("asset", "_held").agg(F.array_sort(F.collect_list(F.struct("ts", F.ln("close").alias("x")))).alias("_s"))
    series = series.select("asset", "_held", F.transform("_s", lambda p: p["x"]).alias("x"))
    whole = series.join(stable, "asset", "left").join(cycle_now, "asset", "left").join(cycle_then, "asset", "left")

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                x, held = np.asarray(r.x, float), int(r.held)
                past, truth = x[:-held], x[-held:]
                trial, _ = ssa_forecast(past, len(past) // 4, components, held)
                path, _ = ssa_forecast(x, len(x) // 4, components, ahead)
                paths = [(holdout_skill(trial, truth, past[-1]), path - x[-1])]
                still = 1.0 if not gate else 0.0 if pd.isna(r.stability) else float(r.stability)
                known = r.cycle_path is not None
                skill = holdout_skill(past[-1] + np.asarray(r.cycle_trial, float), truth, past[-1]) if known and r.cycle_trial is not None else 0.0
                paths.append((skill * still, np.asarray(r.cycle_path, float) * still if known else np.zeros(ahead)))
                total = sum(w for w, _ in paths)
                if total > 0:
                    mixed = sum(w / total * p for w, p in paths)
                    out += [(r.asset, k + 1, mixed[k], paths[0][1][k], paths[1][1][k], still, paths[0][0] / total, paths[1][0] / total) for k in range(ahead)]
            yield pd.DataFrame(out, columns=["asset", "step", "value", "ssa", "cycle", "stability", "ssa_weight", "cycle_weight"])

    columns = whole.select("asset", F.col("_held").alias("held"), "x", "stability", "cycle_path", "cycle_trial")
    return columns.mapInPandas(run, "asset string, step int, value double, ssa double, cycle double, stability double, ssa_weight double, cycle_weight double")


def trials(bars: DataFrame, windows: tuple[int, ...], components: tuple[int, ...], cuts: tuple[float, ...], horizon: int = 20, least: int = 400) -> DataFrame:
    """asset, cut, window, components, skill of every configuration on every asset and cut point: 1 - error over that of standing still, below 0 if it
    does harm. A window of 0 is a quarter of the training series. Cuts with a shorter past than ``least`` or without a whole horizon after them aren't tried."""
    back = F.row_number().over(Window.partitionBy("asset").orderBy("ts"))
    rows = bars.select("asset", "ts", "close", back.alias("_at"), F.count(F.lit(1)).over(Window.partitionBy("asset")).alias("_n"))
    parts = rows.withColumn("cut", F.explode(F.array(*[F.floor(F.col("_n") * c).cast("int") for c in cuts])))
    parts = parts.where((F.col("cut") >= least) & (F.col("cut") + horizon < F.col("_n")) & (F.col("_at") <= F.col("cut") + horizon))
    whole = parts.groupBy("asset", "cut").agg(F.array_sort(F.collect_list(F.struct("ts", "close"))).alias("_s")).select("asset", "cut", F.transform("_s", lambda p: p["close"]).alias("close"))

    def run(batches):
        for batch in batches:
            out = []
            for asset, cut, closes in zip(batch["asset"], batch["cut"], batch["close"], strict=True):
                closes = np.asarray(closes, float)
                past = np.log(np.where(closes[:cut] > 0, closes[:cut], 1.0))
                truth = np.where(closes[cut:] > 0, np.log(np.where(closes[cut:] > 0, closes[cut:], 1.0)), past[-1])
                still = np.abs(past[-1] - truth).sum()
                for window in windows if still > 0 else ():
                    for count in components:
                        path, _ = ssa_forecast(past, window or len(past) // 4, count, horizon)
                        out.append((asset, cut, window, count, 1 - np.abs(path - truth).sum() / still))
            yield pd.DataFrame(out, columns=["asset", "cut", "window", "components", "skill"])

    return whole.repartition("asset", "cut").mapInPandas(run, "asset string, cut int, window int, components int, skill double")


def best_configurations(tried: DataFrame) -> DataFrame:
    """window, components, skill, skill_sd, evaluations of each configuration."""
    return tried.groupBy("window", "components").agg(F.avg("skill").alias("skill"), F.coalesce(F.stddev_samp("skill"), F.lit(0.0)).alias("skill_sd"), F.count(F.lit(1)).alias("evaluations"))
