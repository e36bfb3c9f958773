"""Chords: the strongest periods of an asset in an epoch sounding together, their catalogue, and where they go on to.

Patterns come from spectral.frequency_patterns. Everything but the catalogue's clustering is grouping, joins and array expressions.
"""

from __future__ import annotations

import math
from bisect import insort

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spectral import detrended, fourier, frequency_patterns


def chords(patterns: DataFrame, voices: int = 3, least_share: float = 0.6) -> DataFrame:
    """asset, epoch, periods, amplitudes, phases, prominence, stability: of the patterns of an asset and epoch the ``voices`` strongest that reach a share of
    the strongest one's prominence, longest period first. Amplitudes are those against the first voice, 1 where that has none;
    prominence and stability are means."""
    own = Window.partitionBy("asset", "epoch")
    rows = patterns.withColumn("_most", F.max("prominence").over(own)).where(F.col("prominence") >= F.col("_most") * least_share)
    rows = rows.withColumn("_n", F.row_number().over(own.orderBy(F.desc("prominence"), F.desc("period")))).where(F.col("_n") <= voices)
    voice = F.struct((-F.col("period")).alias("order"), "period", "amplitude", "phase")
    gathered = rows.groupBy("asset", "epoch").agg(F.array_sort(F.collect_list(voice)).alias("_v"), F.avg("prominence").alias("prominence"), F.avg("stability").alias("stability"))
    base = F.get("_v", 0)["amplitude"]
    relative = F.transform("_v", lambda v: F.when((base > 0) & ~F.isnan(v["amplitude"]), F.round(v["amplitude"] / base, 3)).otherwise(1.0))
    absolute = F.transform("_v", lambda v: v["amplitude"])
    return gathered.select("asset", "epoch", F.transform("_v", lambda v: v["period"]).alias("periods"), relative.alias("amplitudes"), absolute.alias("strengths"), F.transform("_v", lambda v: v["phase"]).alias("phases"), "prominence", "stability")


class Leaders:
    """Leader clustering of period lists, strongest first: a list joins the first class whose core it matches in each voice, and the core
    moves to the members' median. Each voice of a class keeps its periods sorted, so a median costs no pass over the members."""

    def __init__(self, tolerance: float):
        self.tolerance, self.cores, self.sorted = tolerance, [], []

    def put(self, periods: list[float]) -> int:
        for number, core in enumerate(self.cores):
            if all(abs(p - c) / c <= self.tolerance for p, c in zip(periods, core, strict=True)):
                for voice, period in zip(self.sorted[number], periods, strict=True):
                    insort(voice, period)
                self.cores[number] = [(v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2 for v in self.sorted[number]]
                return number
        self.cores.append(list(periods))
        self.sorted.append([[p] for p in periods])
        return len(self.cores) - 1


def classified(found: DataFrame, tolerance: float = 0.12) -> DataFrame:
    """chords with voices, octave and class, a number within these two.

    Clustering depends on the order (prominence, then asset and epoch), so it folds within shards: chords of as many voices whose first period
    lies in the same octave. A class that straddles an octave's edge is found once on either side."""
    keys = found.withColumn("voices", F.size("periods")).withColumn("octave", F.floor(F.log2(F.get("periods", 0))).cast("int"))

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part, leaders = part.sort_values(["prominence", "asset", "epoch"], ascending=[False, True, True]), Leaders(tolerance)
        return part[["asset", "epoch", "voices", "octave"]].assign(**{"class": [leaders.put(list(p)) for p in part["periods"]]})

    dealt = keys.select("asset", "epoch", "voices", "octave", "prominence", "periods").groupBy("voices", "octave").applyInPandas(fold, "asset string, epoch long, voices int, octave int, class int")
    return found.join(dealt, ["asset", "epoch"])


def harmonic(periods: Column) -> Column:
    """Name of a chord: one voice is pure; whole fractions of the first period are overtones; other pairs beat, other chords are triads."""
    first = F.get(periods, 0)

    def fits(p: Column) -> Column:
        n = F.rint(first / p)
        return (n >= 2) & (F.abs(first / p - n) / n < 0.08)

    over = F.forall(F.slice(periods, 2, 16), fits)
    return F.when(F.size(periods) == 1, "pure").when(over, "overtone").when(F.size(periods) == 2, "beat").otherwise("triad")


def catalogue(members: DataFrame, least: int = 3) -> DataFrame:
    """voices, octave, class, periods, amplitudes (medians of the members'), harmonic, chords, assets, epochs, prominence, stability of the
    classes of at least so many chords."""
    key = ["voices", "octave", "class"]
    sizes = members.groupBy(*key).agg(F.count(F.lit(1)).alias("chords"), F.count_distinct("asset").alias("assets"), F.count_distinct("epoch").alias("epochs"), F.avg("prominence").alias("prominence"), F.avg("stability").alias("stability")).where(F.col("chords") >= least)
    each = members.select(*key, F.posexplode(F.arrays_zip("periods", "amplitudes")).alias("_at", "_v"))
    medians = each.groupBy(*key, "_at").agg(F.percentile("_v.periods", F.lit(0.5)).alias("p"), F.percentile("_v.amplitudes", F.lit(0.5)).alias("a"))
    cores = medians.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_at", "p", "a"))).alias("_c"))
    cores = cores.select(*key, F.transform("_c", lambda c: c["p"]).alias("periods"), F.transform("_c", lambda c: c["a"]).alias("amplitudes"))
    return sizes.join(cores, key).withColumn("harmonic", harmonic(F.col("periods")))


def class_pairs(members: DataFrame, least: int = 3) -> DataFrame:
    """voices, octave, class, a, b, epochs, mean_lag, lag_sd, steady of two assets with chords of one class in at least so many epochs: by how many bars a's
    first voice runs ahead of b's, and whether it always does by about as much."""
    key = ["voices", "octave", "class", "epoch"]
    side = members.select(*key, "asset", F.get("periods", 0).alias("period"), F.get("phases", 0).alias("phase"))
    a, b = (side.select(*[F.col(c).alias(c) for c in key], *[F.col(c).alias(f"{c}_{s}") for c in ("asset", "period", "phase")]) for s in "ab")
    met = a.join(b, key).where("asset_a < asset_b")
    turn = F.pmod(F.col("phase_b") - F.col("phase_a") + 180, F.lit(360.0)) - 180
    lags = met.withColumn("_lag", turn / 360 * (F.col("period_a") + F.col("period_b")) / 2)
    own = lags.groupBy(*key[:3], F.col("asset_a").alias("a"), F.col("asset_b").alias("b")).agg(F.count(F.lit(1)).alias("epochs"), F.avg("_lag").alias("mean_lag"), F.coalesce(F.stddev_samp("_lag"), F.lit(0.0)).alias("lag_sd")).where(F.col("epochs") >= least)
    return own.withColumn("steady", (F.col("lag_sd") > 0) & (F.abs("mean_lag") > 2 * F.col("lag_sd")) & (F.abs("mean_lag") >= 1))


def sketch(periods: Column, amplitudes: Column, points: int = 96) -> Column:
    """What a chord looks like over two of its longest periods: a cosine sum scaled to 1."""
    both = F.arrays_zip(periods.alias("p"), amplitudes.alias("a"))
    span = 2 * F.get(periods, 0) / (points - 1)

    def height(i: Column) -> Column:
        return F.aggregate(both, F.lit(0.0), lambda acc, v: acc + v["a"] * F.cos(2 * math.pi * i * span / v["p"]))

    curve = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), height)
    most = F.array_max(F.transform(curve, F.abs))
    return F.transform(curve, lambda y: F.when(most > 0, F.round(y / most, 3)).otherwise(y))


def continuation(periods: Column, strengths: Column, phases: Column, bars: Column) -> Column:
    """By how much a chord's sum changes over so many bars from now."""
    voices = F.arrays_zip(periods.alias("p"), strengths.alias("a"), phases.alias("f"))
    ahead = lambda acc, v: acc + v["a"] * (F.cos(2 * math.pi / v["p"] * bars + F.radians(v["f"])) - F.cos(F.radians(v["f"])))
    return F.aggregate(voices, F.lit(0.0), ahead)


def base_forecast(bars: DataFrame, horizons: tuple[int, ...], window: int = 1024, held: int = 40, segment: int = 128, least_prominence: float = 1.2, least_stability: float = 0.0) -> DataFrame:
    """asset, h, skill, voices, value: the log return that the chord of an asset's last ``window`` bars leads to, and how much closer than standing still the
    chord of the window before the last ``held`` bars came to these, 0 to 1.

    value is null beyond the bars that were tested, without a chord, and where it passes three times the usual spread over the way. Assets with fewer bars than
    window and held give no row. Both windows of all assets go through one pass of the pattern operator."""
    w = Window.partitionBy("asset").orderBy(F.desc("ts"))
    rows = bars.where("close > 0").select("asset", "ts", "close", (F.row_number().over(w) - 1).alias("_back"))
    sizes = rows.groupBy("asset").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= window + held).select("asset")
    rows = rows.join(sizes, "asset", "left_semi")
    cut = F.explode(F.array(F.lit(0), F.lit(held)))
    part = rows.withColumn("_cut", cut).where((F.col("_back") >= F.col("_cut")) & (F.col("_back") < F.col("_cut") + window))
    keyed = part.select(F.concat_ws("|", F.col("_cut").cast("string"), "asset").alias("asset"), "ts", "close")
    series = detrended(keyed)
    segments = 2 * window // segment - 1
    found = frequency_patterns(series, fourier(series, range(5, 4 * segment // 5), segment), segment, segments=segments, least_prominence=least_prominence, least_stability=least_stability)
    chord = chords(found).select(F.substring_index("asset", "|", 1).cast("int").alias("_cut"), F.expr("substring(asset, instr(asset, '|') + 1)").alias("asset"), "periods", "strengths", "phases")

    returns = rows.withColumn("_r", F.ln(F.col("close") / F.lag("close").over(Window.partitionBy("asset").orderBy("ts"))))
    spread = returns.groupBy("asset").agg(F.stddev_samp("_r").alias("_sd")).select("asset", F.when(F.col("_sd") > 1e-9, F.col("_sd")).otherwise(0.02).alias("_sd"))
    tail = rows.where(F.col("_back") <= held).groupBy("asset").agg(F.max(F.when(F.col("_back") == held, F.ln("close"))).alias("_base"), F.collect_list(F.when(F.col("_back") < held, F.struct((held - F.col("_back")).alias("step"), F.ln("close").alias("x")))).alias("_tail"))
    trained = tail.join(chord.where(F.col("_cut") == held).drop("_cut"), "asset", "left").withColumn("_t", F.explode("_tail"))
    model = F.col("_base") + continuation(F.col("periods"), F.col("strengths"), F.col("phases"), F.col("_t.step"))
    errors = trained.groupBy("asset").agg(F.sum(F.abs(model - F.col("_t.x"))).alias("_m"), F.sum(F.abs(F.col("_base") - F.col("_t.x"))).alias("_s"))
    skill = errors.select("asset", F.coalesce(F.when((F.col("_s") > 0) & F.col("_m").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("_m") / F.col("_s")))), F.lit(0.0)).alias("skill"))
    now = skill.join(spread, "asset").join(chord.where("_cut = 0").drop("_cut"), "asset", "left").withColumn("h", F.explode(F.array(*map(F.lit, horizons))))
    value = continuation(F.col("periods"), F.col("strengths"), F.col("phases"), F.col("h"))
    kept = F.when((F.col("h") <= held) & (F.abs(value) <= 3 * F.col("_sd") * F.sqrt("h")), value)
    return now.select("asset", "h", "skill", F.coalesce(F.size("periods"), F.lit(0)).alias("voices"), kept.alias("value"))
