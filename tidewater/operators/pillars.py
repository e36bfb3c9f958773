"""What single sources add to a forecast, each with the merit that its own past has earned, and the view that mixes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.series import clamp

from .triggers import triggers, with_forward

SPANS = (1, 5, 20)


def trigger_effects(indicated: DataFrame, classes: DataFrame) -> DataFrame:
    """cls, kind, excess1, hit1, excess5, ...: each trigger's median forward return over that of all days of its class, and how often the return had the
    trigger's sign, after 1, 5 and 20 bars."""
    rows = with_forward(indicated, SPANS).join(classes.select("asset", "cls"), "asset")
    base = rows.groupBy("cls").agg(*[F.percentile(f"fwd{n}", F.lit(0.5)).alias(f"base{n}") for n in SPANS])
    hit = lambda n: F.avg(F.when(F.col(f"fwd{n}").isNotNull(), (F.signum(f"fwd{n}") == F.col("direction")).cast("double")))
    found = triggers(rows).groupBy("cls", "kind").agg(*[F.percentile(f"fwd{n}", F.lit(0.5)).alias(f"median{n}") for n in SPANS], *[hit(n).alias(f"hit{n}") for n in SPANS])
    each = [c for n in SPANS for c in ((F.col(f"median{n}") - F.col(f"base{n}")).alias(f"excess{n}"), F.col(f"hit{n}"))]
    return found.join(base, "cls").select("cls", "kind", *each)


def between_spans(at1: Column, at5: Column, at20: Column, days: Column) -> Column:
    """A value measured after 1, 5 and 20 days, straight between these and level beyond."""
    return F.when(days <= 1, at1).when(days <= 5, at1 + (days - 1) / 4 * (at5 - at1)).when(days <= 20, at5 + (days - 5) / 15 * (at20 - at5)).otherwise(at20)


def knowledge(active: DataFrame, effects: DataFrame, classes: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """asset, h (days), value, merit, patterns of the triggers active on an asset, each kind once.

    A trigger's effect is its excess in its own direction; one that its past contradicts adds nothing. Its merit grows with the distance of its hit rate from a
    coin's; beyond 20 days, where nothing is measured, the hit rate fades to a coin's within 60 more. value is the effects' mean by merit, merit
    their sum over all active kinds."""
    kinds = active.groupBy("asset", "kind").agg(F.max_by("direction", "ts").alias("direction"))
    met = kinds.join(classes.select("asset", "cls"), "asset").join(effects, ["cls", "kind"]).withColumn("h", F.explode(F.array(*map(F.lit, horizons))))
    days = F.col("h")
    effect = between_spans(*[F.col(f"excess{n}") * F.col("direction") for n in SPANS], days)
    fading = 0.5 + (F.col("hit20") - 0.5) * F.greatest(F.lit(0.0), 1 - (days - 20) / 60)
    hit = F.when(days > 20, fading).otherwise(between_spans(*[F.col(f"hit{n}") for n in SPANS], days))
    merit = F.when(hit.isNotNull(), clamp((F.abs(hit - 0.5) - 0.02) / 0.08, 0.0, 1.0))
    rows = met.select("asset", "h", effect.alias("_u"), F.when(effect > 0, F.coalesce(merit, F.lit(0.0))).otherwise(0.0).alias("_m"))
    sums = rows.groupBy("asset", "h").agg(F.sum(F.col("_u") * F.col("_m")).alias("_s"), F.sum("_m").alias("_w"), F.count(F.lit(1)).alias("patterns")).where(F.col("_w") > 1e-9)
    return sums.select("asset", "h", (F.col("_s") / F.col("_w")).alias("value"), clamp(F.col("_w") / F.col("patterns"), 0.0, 1.0).alias("merit"), "patterns")


def semantic(moods: DataFrame, calibrated: DataFrame) -> DataFrame:
    """asset, h, value, merit, texts: an asset's mood times what a mood has been worth at each horizon. Without a calibration the mood moves
    nothing, but it is shown. moods: asset, mood, texts; calibrated: h, slope, skill, a row a horizon."""
    rows = moods.crossJoin(calibrated.select("h", "slope", "skill"))
    return rows.select("asset", "h", (F.col("mood") * F.col("slope")).alias("value"), clamp(F.col("skill"), 0.0, 1.0).alias("merit"), "texts")


def combined_view(contributions: DataFrame) -> DataFrame:
    """asset, h, value, effective, pillars, carried, verdict, trace of contributions (asset, h, pillar, value, weight, merit), of which any may be missing.

    They are mixed by weight times merit. Where no pillar has merit the weights alone decide, and where those are all 0 each counts alike;
    verdict says which: one, several, weights or equal. effective is the sum of weights times merits in hundreds, carried the pillars with merit, trace each
    pillar's share, in order of names."""
    own = Window.partitionBy("asset", "h")
    w = F.col("weight") * F.col("merit")
    rows = contributions.withColumn("_w", F.sum(w).over(own)).withColumn("_v", F.sum("weight").over(own)).withColumn("_n", F.count(F.lit(1)).over(own))
    share = F.when(F.col("_w") > 1e-9, w / F.col("_w")).when(F.col("_v") > 0, F.col("weight") / F.col("_v")).otherwise(1 / F.col("_n"))
    rows = rows.withColumn("share", share)
    earned = F.sum((F.col("merit") > 0).cast("int"))
    verdict = F.when(F.max("_w") > 1e-9, F.when(earned == 1, "one").otherwise("several")).when(F.max("_v") > 0, "weights").otherwise("equal")
    return rows.groupBy("asset", "h").agg(
        F.sum(F.col("value") * F.col("share")).alias("value"), (F.max("_w") / 100).alias("effective"), F.count(F.lit(1)).alias("pillars"), earned.cast("long").alias("carried"), verdict.alias("verdict"),
        F.array_sort(F.collect_list(F.struct("pillar", "value", "merit", "share"))).alias("trace"),
    )
