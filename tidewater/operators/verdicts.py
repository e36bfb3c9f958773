"""Verdicts on assets: what became of them, and what they add to a forecast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.series import clamp, own

from .align import as_of


def scored(verdicts: DataFrame, bars: DataFrame, after: int = 5) -> DataFrame:
    """verdicts (verdict_id, asset, asked, direction, confidence) whose ``after``-th bar has come: realised, the log return from the close at
    or before the verdict, and hit, whether its sign is the direction's (null without a direction)."""
    bars = bars.where("close > 0")
    later = bars.select("asset", F.col("ts").alias("close_ts"), F.lead("close", after).over(own()).alias("_later"))
    met = as_of(verdicts, bars).join(later, ["asset", "close_ts"]).where("_later IS NOT NULL")
    rows = met.withColumn("realised", F.ln(F.col("_later") / F.col("close")))
    return rows.withColumn("hit", F.when(F.col("direction") != 0, F.signum("realised") == F.signum(F.col("direction").cast("double")))).drop("_later", "close", "close_ts")


def merit(scores: DataFrame, least: int = 20) -> DataFrame:
    """One row, merit: from the hit rate of verdicts with a direction, a coin's being 0 and 70 % being 1; a quarter before ``least`` scores."""
    own_ = scores.where("direction <> 0").agg(F.count(F.lit(1)).alias("_n"), F.avg(F.col("hit").cast("double")).alias("_q"))
    return own_.select(F.when(F.col("_n") < least, 0.25).otherwise(clamp((F.col("_q") - 0.5) / 0.2, 0.0, 1.0)).alias("merit"))


def contributions(verdicts: DataFrame, bars: DataFrame, merits: DataFrame, horizons: tuple[int, ...], days: int = 3, spread_days: int = 180) -> DataFrame:
    """asset, h, value, merit of each asset's newest verdict of the last days: half its direction times its confidence in units of the
    asset's own daily spread, growing with the root of the horizon. Verdicts without a direction add nothing."""
    now = verdicts.agg(F.max("asked").alias("_now"))
    recent = verdicts.join(F.broadcast(now)).where(F.col("asked") >= F.col("_now") - F.make_dt_interval(F.lit(days)))
    newest = recent.groupBy("asset").agg(F.max(F.struct("asked", "verdict_id", "direction", "confidence")).alias("_v")).select("asset", "_v.direction", "_v.confidence").where("direction <> 0")
    tail = bars.where("close > 0").join(F.broadcast(now)).where(F.col("ts") >= F.col("_now") - F.make_dt_interval(F.lit(spread_days)))
    spread = tail.select("asset", F.ln(F.col("close") / F.lag("close").over(Window.partitionBy("asset").orderBy("ts"))).alias("_r")).groupBy("asset").agg(F.stddev_samp("_r").alias("_s")).where("_s > 0")
    rows = newest.join(spread, "asset").join(F.broadcast(merits)).withColumn("h", F.explode(F.array(*map(F.lit, horizons))))
    return rows.select("asset", "h", (F.col("direction") / 2 * F.col("confidence") * F.col("_s") * F.sqrt("h")).alias("value"), "merit")
