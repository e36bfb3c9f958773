"""Forecasts: models as window functions of the past, their mixture, scores against what arrived, learning of weights.

Every forecast of every asset, time and horizon comes out of one pass over the windows; no asset is looped over.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.series import clamp, last_rows, own

MODELS = ("naive", "drift", "momentum", "meanrev")


def forecasts(bars: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """asset, ts, rn, h, close, a prediction of the log return over h bars by each model, target_ts and actual_close.

    Models with too short a past predict 0; target and actual are null where the target isn't reached yet.
    """
    w, c = own(), F.col("close")
    rows = bars.where("close > 0").withColumn("rn", F.row_number().over(w)).withColumn("r", F.ln(c / F.lag("close").over(w)))
    w200, w120, w50 = last_rows(200), last_rows(120), last_rows(50)
    x = F.ln(c)
    trend = F.aggregate(F.collect_list("r").over(w120), F.lit(None).cast("double"), lambda acc, r: F.when(acc.isNull(), r).otherwise(0.2 * r + 0.8 * acc))
    rows = rows.select(
        "asset", "ts", "rn", "close", "r",
        F.when(F.count("r").over(w200) >= 5, F.avg("r").over(w200)).otherwise(0.0).alias("_drift"),
        F.when(F.count("r").over(w120) >= 5, trend).otherwise(0.0).alias("_trend"),
        F.when((F.count(x).over(w50) >= 10) & (F.stddev_samp(x).over(w50) > 0), x - F.avg(x).over(w50)).otherwise(0.0).alias("_off"),
        *[F.lead("ts", h).over(w).alias(f"_t{h}") for h in horizons], *[F.lead("close", h).over(w).alias(f"_c{h}") for h in horizons],
    )
    each = F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"_t{h}").alias("target_ts"), F.col(f"_c{h}").alias("actual_close")) for h in horizons])
    rows = rows.withColumn("_e", F.explode(each))
    h = F.col("_e.h")
    return rows.select(
        "asset", "ts", "rn", h.alias("h"), "close", F.lit(0.0).alias("naive"), (F.col("_drift") * h).alias("drift"), (F.col("_trend") * (1 - F.pow(F.lit(0.5), h)) / 0.5).alias("momentum"),
        (-F.col("_off") * F.least(F.lit(1.0), 0.15 * F.sqrt(h))).alias("meanrev"), "_e.target_ts", "_e.actual_close",
    )


def long_form(made: DataFrame) -> DataFrame:
    """One row for each model of a forecast: model, predicted."""
    each = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("predicted")) for m in MODELS])
    return made.withColumn("_m", F.explode(each)).select("asset", "ts", "rn", "h", "close", "target_ts", "actual_close", "_m.model", "_m.predicted")


def combine(made: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """made with combined, the mean of the clamped predictions (weighed by weights asset, h, model, weight), and their spread."""
    rows = long_form(made)
    rows = rows.withColumn("weight", F.lit(1.0)) if weights is None else rows.join(weights, ["asset", "h", "model"], "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    p = clamp(F.col("predicted"), -0.5, 0.5)
    return rows.groupBy("asset", "ts", "rn", "h", "close", "target_ts", "actual_close").agg((F.sum(p * F.col("weight")) / F.sum("weight")).alias("combined"), F.coalesce(F.stddev_samp(p), F.lit(0.0)).alias("spread"))


def ensemble(made: DataFrame, weights: DataFrame, hits: DataFrame) -> DataFrame:
    """made (of the forecasts to be given out) with combined, spread, confidence and the models' clamped predictions.

    Models are weighed by what they have learned (weights: asset, h, model, weight). The confidence is their hit rate so weighed (hits: asset, h,
    model, hit_rate; a half before any), less the more they disagree."""
    rows = long_form(made).join(weights, ["asset", "h", "model"], "left").join(hits, ["asset", "h", "model"], "left")
    w, p = F.coalesce("weight", F.lit(1.0 / len(MODELS))), clamp(F.col("predicted"), -0.5, 0.5)
    own_ = rows.groupBy("asset", "h", "ts", "close", "target_ts").agg(
        (F.sum(w * p) / F.sum(w)).alias("combined"), F.coalesce(F.stddev_samp(p), F.lit(0.0)).alias("spread"), F.coalesce(F.try_divide(F.sum(F.when(F.col("hit_rate").isNotNull(), w * F.col("hit_rate"))), F.sum(F.when(F.col("hit_rate").isNotNull(), w))), F.lit(0.5)).alias("_q"),
        *[F.max(F.when(F.col("model") == m, p)).alias(m) for m in MODELS],
    )
    return own_.withColumn("confidence", clamp(F.col("_q") / (1 + 20 * F.col("spread")), 0.0, 1.0)).drop("_q")


def model_hits(made: DataFrame) -> DataFrame:
    """asset, h, model, hit_rate over all arrived forecasts."""
    rows = long_form(made).where("actual_close IS NOT NULL")
    hit = direction_hit(F.col("predicted"), F.ln(F.col("actual_close") / F.col("close")))
    return rows.groupBy("asset", "h", "model").agg(F.avg(hit.cast("double")).alias("hit_rate"))


def direction_hit(predicted: Column, actual: Column) -> Column:
    """Whether the direction was right; where hardly anything moved, a call of hardly anything."""
    return F.when(F.abs(actual) < 1e-6, F.abs(predicted) < 1e-3).otherwise(F.signum(predicted) == F.signum(actual))


def scored(combined: DataFrame) -> DataFrame:
    """The forecasts whose target has arrived: actual return, error in percent of the base close, direction."""
    base, arrived = F.col("close"), F.col("actual_close")
    rows = combined.where(arrived.isNotNull()).withColumn("actual_return", F.ln(arrived / base)).withColumn("predicted_close", base * F.exp("combined"))
    return rows.withColumn("abs_pct_error", 100 * F.abs(F.col("predicted_close") - arrived) / base).withColumn("hit", direction_hit(F.col("combined"), F.col("actual_return")))


def accuracy(scores: DataFrame, by: list[str]) -> DataFrame:
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("abs_pct_error").alias("mean_error"), F.avg(F.col("hit").cast("double")).alias("hit_rate"))


def quality(scores: DataFrame, least: int) -> DataFrame:
    """Each asset and horizon, one forecast for each target day: errors against standing still, best ratio first."""
    latest = Window.partitionBy("asset", "h", F.to_date("target_ts")).orderBy(F.desc("ts"))
    one = scores.withColumn("_n", F.row_number().over(latest)).where("_n = 1")
    still = 100 * F.abs(F.col("close") - F.col("actual_close")) / F.col("close")
    own_ = one.groupBy("asset", "h").agg(F.count(F.lit(1)).alias("n"), F.avg("abs_pct_error").alias("mean_error"), F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.avg(still).alias("still_error"))
    return own_.where(F.col("n") >= least).withColumn("ratio", F.try_divide(F.col("mean_error"), F.col("still_error")))


def learned_weights(made: DataFrame, eta: float = 0.5, floor: float = 0.01, penalty: float = 1.2) -> DataFrame:
    """asset, h, model, weight after all arrived forecasts: each weight shrinks with its model's loss, is kept above a
    floor and normalised. A forecast teaches when its target arrives, so the fold runs in order of target."""
    rows = made.where("actual_close IS NOT NULL").select("asset", "h", "target_ts", F.ln(F.col("actual_close") / F.col("close")).alias("actual"), F.array(*MODELS).alias("p"))
    lists = rows.groupBy("asset", "h").agg(F.array_sort(F.collect_list(F.struct("target_ts", "actual", "p"))).alias("_l"))
    start = F.array(*[F.lit(1.0 / len(MODELS)) for _ in MODELS])

    def loss(p: Column, a: Column) -> Column:
        scale = F.greatest(F.lit(0.002), 2 * F.abs(a))
        off = F.least(F.lit(4.0), F.abs(p - a) / scale)
        wrong = (F.abs(a) > 1e-5) & ((F.abs(p) < 1e-4) | (F.signum(p) != F.signum(a)))
        return off + F.when(wrong, penalty).otherwise(0.0)

    def step(w: Column, row: Column) -> Column:
        shrunk = F.zip_with(w, row["p"], lambda x, p: x * F.exp(-eta * loss(p, row["actual"])))
        total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
        lifted = F.transform(shrunk, lambda x: F.greatest(F.lit(floor), x / total(shrunk)))
        return F.transform(lifted, lambda x: x / total(lifted))

    folded = lists.select("asset", "h", F.posexplode(F.aggregate("_l", start, step)).alias("_k", "weight"))
    return folded.select("asset", "h", F.element_at(F.array(*map(F.lit, MODELS)), F.col("_k") + 1).alias("model"), "weight")


def walk_forward(made: DataFrame, history: int = 60, eta: float = 0.5, floor: float = 0.01, penalty: float = 1.2) -> DataFrame:
    """made with combined: each forecast mixed by the weights that the forecasts arrived by then had taught, from the ones made after
    ``history`` bars on. Forecasts without an outcome yet don't count.

    Predictions come from windows for all times at once; only the weights, four numbers a step, are walked along each series."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rn").reset_index(drop=True)
        p, actual, h = part[list(MODELS)].to_numpy(), np.log(part["actual_close"] / part["close"]).to_numpy()[:, None], int(part["h"].iloc[0])
        loss = np.minimum(4.0, np.abs(p - actual) / np.maximum(0.002, 2 * np.abs(actual)))
        loss += penalty * ((np.abs(actual) > 1e-5) & ((np.abs(p) < 1e-4) | (np.sign(p) != np.sign(actual))))
        shrink, w = np.exp(-eta * loss), np.full((len(part) + 1, len(MODELS)), 1.0 / len(MODELS))
        for i, by in enumerate(shrink):
            now = w[i] * by
            now = np.maximum(floor, now / now.sum())
            w[i + 1] = now / now.sum()
        arrived = np.searchsorted(part["rn"].to_numpy() + h, part["rn"].to_numpy(), side="right")
        part["combined"] = (w[arrived] * np.clip(p, -0.5, 0.5)).sum(axis=1)
        return part[["asset", "ts", "rn", "h", "close", "target_ts", "actual_close", "combined"]]

    rows = made.where((F.col("rn") > history) & F.col("actual_close").isNotNull()).select("asset", "ts", "rn", "h", "close", "target_ts", "actual_close", *MODELS)
    return rows.groupBy("asset", "h").applyInPandas(run, "asset string, ts timestamp, rn int, h int, close double, target_ts timestamp, actual_close double, combined double")


def mix_pillars(rows: DataFrame) -> DataFrame:
    """asset, h, basis, extra, mixed, pillars, trace of pillars (asset, h, pillar, value, merit, slider, surcharge): the basis is the merit-
    and slider-weighted mean; surcharges are added up to the larger of 1 % and the basis itself. trace holds each pillar with what it adds: its
    part of the basis, or of the surcharges as capped."""
    w, up = F.col("merit") * F.col("slider"), F.col("surcharge")
    each = F.array_sort(F.collect_list(F.struct("pillar", "value", "merit", "slider", "surcharge")))
    sums = rows.groupBy("asset", "h").agg(F.sum(F.when(~up, F.col("value") * w)).alias("_s"), F.sum(F.when(~up, w)).alias("_w"), F.sum(F.when(up, F.col("value") * w / 100).otherwise(0.0)).alias("_x"), F.count(F.lit(1)).alias("pillars"), each.alias("_p"))
    own_ = sums.withColumn("basis", F.coalesce(F.try_divide(F.col("_s"), F.col("_w")), F.lit(0.0)))
    cap = F.greatest(F.lit(0.01), F.abs("basis"))
    own_ = own_.withColumn("extra", F.greatest(-cap, F.least(cap, F.col("_x"))))

    def added(p: Column) -> Column:
        part = F.when(p["surcharge"], F.coalesce(F.try_divide(p["value"] * p["merit"] * p["slider"] / 100 * F.col("extra"), F.col("_x")), F.lit(0.0)))
        return F.struct(p["pillar"].alias("pillar"), p["value"].alias("value"), p["merit"].alias("merit"), part.otherwise(F.coalesce(F.try_divide(p["value"] * p["merit"] * p["slider"], F.col("_w")), F.lit(0.0))).alias("adds"))

    return own_.select("asset", "h", "basis", "extra", (F.col("basis") + F.col("extra")).alias("mixed"), "pillars", F.transform("_p", added).alias("trace"))


def own_merit(hit: Column, n: Column) -> Column:
    """A forecaster's merit from its hit rate; a quarter before it has twenty scores."""
    return F.when(n >= 20, clamp((hit - 0.523) / 0.10, 0.0, 1.0)).otherwise(0.25)
