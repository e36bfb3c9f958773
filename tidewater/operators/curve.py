"""Curves: smoothing, derivatives, features of a curve and links between them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.series import last_rows, own, severity, upper_median


def smooth(bars: DataFrame, value: str, alpha: float) -> DataFrame:
    """bars with smoothed: exponential smoothing that starts at the first value, along each series."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ts")
        return part.assign(smoothed=part[value].ewm(alpha=alpha, adjust=False).mean())

    return bars.groupBy("asset").applyInPandas(run, T.StructType([*bars.schema.fields, T.StructField("smoothed", T.DoubleType())]))


def thinned(events: DataFrame, gap: int, keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """Events (keys, i, ...) without those less than ``gap`` positions after the last one kept of their keys."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part, kept, last = part.sort_values("i"), [], None
        for i in part["i"]:
            fine = last is None or i - last >= gap
            last = i if fine else last
            kept.append(fine)
        return part[kept]

    return events.groupBy(*keys).applyInPandas(run, events.schema)


def derivative_events(bars: DataFrame, alpha: float = 2 / 11, scale: int = 120, least: float = 3.0, gap: int = 10) -> DataFrame:
    """asset, i, ts, z: jumps of the first difference of the smoothed log price, in units of its median size before."""
    rows = smooth(bars.where("close > 0").withColumn("x", F.ln("close")), "x", alpha)
    rows = rows.withColumn("i", F.row_number().over(own()).cast("long")).withColumn("d", F.col("smoothed") - F.lag("smoothed").over(own()))
    median = F.when(F.count("d").over(last_rows(scale, 1)) == scale, F.percentile(F.abs("d"), F.lit(0.5)).over(last_rows(scale, 1)))
    rows = rows.withColumn("z", F.try_divide(F.abs("d"), F.when(median > 1e-12, median * 1.4826)))
    return thinned(rows.where(F.col("z") >= least).select("asset", "i", "ts", "z", F.signum("d").cast("int").alias("sign")), gap)


def kernels(m: int) -> tuple[list[float], list[float], list[float]]:
    """Weights of value, slope and curvature of the quadratic through 2 m + 1 equally spaced points."""
    at = range(-m, m + 1)
    s0, s2, s4 = 2 * m + 1, sum(j * j for j in at), sum(j**4 for j in at)
    det = s0 * s4 - s2 * s2
    return [(s4 - s2 * j * j) / det for j in at], [j / s2 for j in at], [2 * (s0 * j * j - s2) / det for j in at]


def local_quadratic(bars: DataFrame, m: int) -> DataFrame:
    """bars with i, x (log price), value, slope and curvature of a centred local quadratic; at the edges the raw value and nulls."""
    rows = bars.where("close > 0").withColumn("x", F.ln("close")).withColumn("i", F.row_number().over(own()).cast("long"))
    around = [F.lag("x", -j).over(own()) for j in range(-m, m + 1)]

    def fit(weights: list[float]) -> Column:
        total = F.lit(0.0)
        for w, x in zip(weights, around, strict=True):
            total = total + F.lit(w) * x
        return total

    value, slope, curvature = map(fit, kernels(m))
    return rows.withColumn("value", F.coalesce(value, F.col("x"))).withColumn("slope", slope).withColumn("curvature", curvature)


def curve_features(bars: DataFrame, m: int = 5, scale: int = 250, least: int = 20, gap: int = 5) -> DataFrame:
    """asset, i, ts, kind, z, severity: highs, lows, inflections, saddles, breaks of slope and curvature, jumps.

    Slope, curvature and residual are measured by the upper median of their sizes over the ``scale`` bars before.
    """
    rows = local_quadratic(bars, m).withColumn("residual", F.col("x") - F.col("value"))
    before = last_rows(scale, 1)
    for c in ("slope", "curvature", "residual"):
        size = F.filter(F.collect_list(F.abs(c)).over(before), lambda v: v > 0)
        rows = rows.withColumn(f"_{c}", F.when(F.size(size) >= scale // 2, upper_median(size)))
        rows = rows.withColumn(f"z_{c}", F.try_divide(F.abs(c), F.when(F.col(f"_{c}") > 1e-12, F.col(f"_{c}") * 1.4826)))
    was = lambda c: F.lag(c).over(own())
    rows = rows.withColumn("_s", was("slope")).withColumn("_c", was("curvature")).withColumn("_zs", F.max("z_slope").over(last_rows(10, 1)))
    turned = (F.col("_s") * F.col("slope") < 0) & F.col("z_curvature").isNotNull()
    kinds = [
        ("high", turned & (F.col("curvature") < 0), F.col("z_curvature")),
        ("low", turned & (F.col("curvature") > 0), F.col("z_curvature")),
        ("inflection", F.col("_c") * F.col("curvature") < 0, F.col("z_slope")),
        ("saddle", (F.col("z_slope") < 0.35) & (F.col("z_curvature") < 0.35) & (F.col("_zs") >= 2.5), F.col("_zs")),
        ("slope_break", F.col("z_slope") >= 2.5, F.col("z_slope")),
        ("curvature_break", F.col("z_curvature") >= 2.5, F.col("z_curvature")),
        ("jump", F.col("z_residual") >= 3.5, F.col("z_residual")),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)) & z.isNotNull(), F.struct(F.lit(k).alias("kind"), z.alias("z"))) for k, test, z in kinds]))
    each = rows.select("asset", "i", "ts", F.explode(found).alias("_f")).select("asset", "i", "ts", "_f.kind", "_f.z").withColumn("severity", severity(F.col("z")))
    return thinned(each.where(F.col("severity") >= least).select("asset", "kind", "i", "ts", "z", "severity"), gap, ("asset", "kind"))


def link_events(events: DataFrame, days: DataFrame, width: int = 3, least_pairs: int = 8, least_days: int = 200, least_lift: float = 1.3) -> DataFrame:
    """Which kinds of events of two assets come together: pairs within ``width`` common days, how many chance would
    give, lift, median lag and how often b follows. days: asset, ts, the trading days of all assets."""
    n = days.select("ts").distinct().withColumn("d", F.row_number().over(Window.orderBy("ts")).cast("long"))
    x, y = days.select(F.col("asset").alias("a"), "ts"), days.select(F.col("asset").alias("b"), "ts")
    common = x.join(y, "ts").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("days")).where(F.col("days") >= least_days)
    placed = events.select("asset", "kind", "ts").join(n, "ts")
    counts = placed.groupBy("asset", "kind").agg(F.count(F.lit(1)).alias("n"))
    left = placed.select(F.col("asset").alias("a"), F.col("kind").alias("kind_a"), F.col("d").alias("da"), F.floor(F.col("d") / width).alias("_k"))
    right = placed.select(F.col("asset").alias("b"), F.col("kind").alias("kind_b"), F.col("d").alias("db"), F.explode(F.array(*[F.floor(F.col("d") / width) + k for k in (-1, 0, 1)])).alias("_k"))
    met = left.join(right, "_k").where((F.col("a") < F.col("b")) & (F.abs(F.col("db") - F.col("da")) <= width)).withColumn("lag", F.col("db") - F.col("da"))
    pairs = met.groupBy("a", "b", "kind_a", "kind_b").agg(F.count(F.lit(1)).alias("pairs"), upper_median(F.collect_list("lag")).alias("median_lag"), F.avg((F.col("lag") > 0).cast("double")).alias("lead_share"))
    pairs = pairs.where(F.col("pairs") >= least_pairs).join(common, ["a", "b"])
    for side in ("a", "b"):
        pairs = pairs.join(counts.select(F.col("asset").alias(side), F.col("kind").alias(f"kind_{side}"), F.col("n").alias(f"n_{side}")), [side, f"kind_{side}"])
    expected = F.col("n_a") * F.col("n_b") * (2 * width + 1) / F.col("days")
    return pairs.withColumn("expected", expected).withColumn("lift", F.col("pairs") / expected).where(F.col("lift") >= least_lift).select("a", "b", "kind_a", "kind_b", "pairs", "expected", "lift", "median_lag", "lead_share")


def curve_run(bars: DataFrame, path: str, label: str, **limits: float) -> DataFrame:
    """Writes a run into three tables under path, each partitioned by run: its events, the links between them, and its header. Gives the headers of all runs there.

    Links are made from the events as written. A run that is written again replaces its own partitions and no others."""
    spark = bars.sparkSession

    def put(df: DataFrame, table: str) -> DataFrame:
        df.withColumn("run", F.lit(label)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{path}/{table}")
        return spark.read.parquet(f"{path}/{table}").where(F.col("run") == label)

    events = put(curve_features(bars), "events")
    links = put(link_events(events, bars.select("asset", "ts"), **limits), "links")
    head = bars.agg(F.count_distinct("asset").alias("assets"), F.count(F.lit(1)).alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    for name, df in (("events", events), ("links", links)):
        head = head.crossJoin(df.agg(F.count(F.lit(1)).alias(name)))  # one row each
    put(head, "runs")
    return spark.read.parquet(f"{path}/runs")


def strongest_links(links: DataFrame, top: int) -> DataFrame:
    """The links of a run with the highest lift."""
    return links.orderBy(F.desc(F.round("lift", 9)), "a", "b", "kind_a", "kind_b").limit(top)


def type_statistics(events: DataFrame) -> DataFrame:
    """kind, n, assets, mean_severity, max_z of a run's events."""
    return events.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("asset").alias("assets"), F.avg("severity").alias("mean_severity"), F.max("z").alias("max_z"))
