"""Alignment: common timestamps, grids, forward fill, as-of joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.series import own


def intersect_series(bars: DataFrame) -> DataFrame:
    """The bars at timestamps that every series has."""
    n = bars.agg(F.count_distinct("asset").alias("_all"))
    full = bars.groupBy("ts").agg(F.count_distinct("asset").alias("_n")).join(F.broadcast(n)).where("_n = _all").select("ts")
    return bars.join(full, "ts", "left_semi")


def densify(bars: DataFrame) -> DataFrame:
    """Every asset at every timestamp of any, close null where it didn't trade: the dense grid itself, so as many rows as it has."""
    grid = bars.select("ts").distinct().crossJoin(bars.select("asset").distinct())
    return grid.join(bars.select("asset", "ts", "close"), ["asset", "ts"], "left").select("asset", "ts", "close")


def forward_fill(dense: DataFrame, value: str = "close") -> DataFrame:
    """dense with filled: the last value at or before each row, null before the first."""
    return dense.withColumn("filled", F.last(value, ignorenulls=True).over(own().rowsBetween(Window.unboundedPreceding, 0)))


def rebase(bars: DataFrame, value: str = "close") -> DataFrame:
    """bars with rebased: 100 at the first value of the series, or at its first positive one."""
    whole = own().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, positive = F.first(value).over(whole), F.first(F.when(F.col(value) > 0, F.col(value)), ignorenulls=True).over(whole)
    return bars.withColumn("rebased", 100 * F.col(value) / F.when(first > 0, first).otherwise(positive))


def align_by_coverage(bars: DataFrame, grid_share: float = 0.8, asset_share: float = 0.9, least: int = 200) -> DataFrame:
    """asset, ts, filled, filled_share: the grid of timestamps that enough assets have, the assets that have enough of
    it and start positive, forward filled."""
    n = bars.agg(F.count_distinct("asset").alias("_assets"))
    grid = bars.groupBy("ts").agg(F.count_distinct("asset").alias("_n")).join(F.broadcast(n)).where((F.col("_n") >= grid_share * F.col("_assets")) & (F.col("_n") >= 2)).select("ts")
    size = grid.agg(F.count(F.lit(1)).alias("_points"))
    on_grid = bars.join(grid, "ts", "left_semi")
    kept = on_grid.groupBy("asset").agg(F.count(F.lit(1)).alias("_hits"), F.min_by("close", "ts").alias("_first")).join(F.broadcast(size))
    kept = kept.where((F.col("_points") >= least) & (F.col("_hits") >= asset_share * F.col("_points")) & (F.col("_first") > 0))
    kept = kept.select("asset", (1 - F.col("_hits") / F.col("_points")).alias("filled_share"))
    dense = grid.crossJoin(kept).join(on_grid.select("asset", "ts", "close"), ["asset", "ts"], "left")
    return forward_fill(dense).select("asset", "ts", "filled", "filled_share")


def pair_join(bars: DataFrame) -> DataFrame:
    """a, b, ts, ca, cb: each pair of assets a < b at the timestamps that both traded at."""
    left, right = bars.select(F.col("asset").alias("a"), "ts", F.col("close").alias("ca")), bars.select(F.col("asset").alias("b"), "ts", F.col("close").alias("cb"))
    return left.join(right, "ts").where("a < b").select("a", "b", "ts", "ca", "cb")


def latest_price(daily: DataFrame, hourly: DataFrame) -> DataFrame:
    """The newest positive close of each asset over both intervals, hourly ones first at equal times."""
    both = daily.select("asset", "ts", "close", F.lit("1d").alias("interval")).unionByName(hourly.select("asset", "ts", "close", F.lit("1h").alias("interval"))).where("close > 0")
    best = F.max_by(F.struct("close", "interval", "ts"), F.struct("ts", "interval"))
    return both.groupBy("asset").agg(best.alias("_b")).select("asset", "_b.close", "_b.interval", "_b.ts")


def as_of(probes: DataFrame, bars: DataFrame, days: int | None = None) -> DataFrame:
    """probes (asset, asked, ...) with close and close_ts of the newest bar at or before, null if older than so many days.

    Probes and bars are put into one order and the last bar is carried along: one shuffle, no range join.
    """
    rest = [c for c in probes.columns if c not in ("asset", "asked")]
    rows = probes.select("asset", "asked", F.lit(1).alias("_probe"), F.struct(*[F.col(c) for c in rest]).alias("_rest") if rest else F.lit(None).alias("_rest"), F.lit(None).cast("struct<ts:timestamp,close:double>").alias("_bar"))
    known = bars.select("asset", F.col("ts").alias("asked"), F.lit(0).alias("_probe"), F.lit(None).cast(rows.schema["_rest"].dataType).alias("_rest"), F.struct("ts", "close").alias("_bar"))
    order = Window.partitionBy("asset").orderBy("asked", "_probe").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.unionByName(known).withColumn("_last", F.last("_bar", ignorenulls=True).over(order)).where("_probe = 1")
    fresh = F.lit(True) if days is None else F.col("_last.ts") >= F.col("asked") - F.expr(f"INTERVAL {days} DAYS")
    return met.select("asset", "asked", *[F.col(f"_rest.{c}") for c in rest], F.when(fresh, F.col("_last.close")).alias("close"), F.when(fresh, F.col("_last.ts")).alias("close_ts"))


def following(bars: DataFrame, n: int, name: str = "later") -> DataFrame:
    """bars with the close n bars of the asset later."""
    return bars.withColumn(name, F.lead("close", n).over(own()))


def calendar_forward(bars: DataFrame, days: int) -> DataFrame:
    """bars with forward: the last close within so many calendar days after each bar, null if there is none."""
    seconds = F.unix_timestamp("ts")
    ahead = Window.partitionBy("asset").orderBy(seconds).rangeBetween(1, days * 86400)
    return bars.withColumn("forward", F.last("close").over(ahead))


def nearest_within(anchors: DataFrame, made: DataFrame, days: int) -> DataFrame:
    """For each anchor (asset, asked) the row of made (asset, made_at, ...) nearest in time within so many days, earlier first."""
    rows = anchors.withColumn("_day", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn("_bucket", F.floor(F.unix_timestamp("asked") / (86400 * days)) + F.col("_day"))
    dealt = made.withColumn("_bucket", F.floor(F.unix_timestamp("made_at") / (86400 * days)))
    gap = F.abs(F.unix_timestamp("made_at") - F.unix_timestamp("asked"))
    near = rows.join(dealt, ["asset", "_bucket"]).withColumn("gap_s", gap).where(F.col("gap_s") <= days * 86400)
    order = Window.partitionBy("asset", "asked").orderBy("gap_s", "made_at")
    return near.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_day", "_bucket")


def band_join(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """Pairs of events (asset, i) of different assets with positions at most ``width`` apart, by buckets of that width."""
    a = left.select(F.col("asset").alias("a"), F.col("i").alias("ia"), F.floor(F.col("i") / width).alias("_bucket"))
    b = right.select(F.col("asset").alias("b"), F.col("i").alias("ib"), F.explode(F.array(*[F.floor(F.col("i") / width) + k for k in (-1, 0, 1)])).alias("_bucket"))
    return a.join(b, "_bucket").where((F.col("a") < F.col("b")) & (F.abs(F.col("ib") - F.col("ia")) <= width)).select("a", "b", "ia", "ib", (F.col("ib") - F.col("ia")).alias("lag"))


def nearest_event(events: DataFrame, anomalies: DataFrame, width: int) -> DataFrame:
    """events (asset, i) with the nearest anomaly position (the earlier one on a tie), their distance, and whether it is within width.

    Positions are days, so the nearest anomalies before and after are found once for each position and joined to the events."""
    days = events.select("i").distinct().unionByName(anomalies.select(F.col("i").cast(events.schema["i"].dataType).alias("i"))).distinct()
    days = days.join(anomalies.select(F.col("i"), F.col("i").alias("_a")).distinct(), "i", "left")
    order = Window.orderBy("i")
    before = F.last("_a", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_a", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    met = events.select("asset", "i").join(days.select("i", before.cast("long").alias("_before"), after.cast("long").alias("_after")), "i")
    nearest = F.when(F.col("_after").isNull() | (F.col("i") - F.col("_before") <= F.col("_after") - F.col("i")), F.col("_before")).otherwise(F.col("_after"))
    return met.select("asset", "i", nearest.alias("nearest"), (F.col("i") - nearest).alias("lag"), (F.abs(F.col("i") - nearest) <= width).alias("hit"))


def share_of_total(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Sums by group and their share of the whole; the total is one row."""
    sums = rows.groupBy(*by).agg(F.sum(value).alias("amount"))
    return sums.join(F.broadcast(sums.agg(F.sum("amount").alias("_total")))).select(*by, "amount", (F.col("amount") / F.col("_total")).alias("share"))


def decimate(rows: DataFrame, points: int) -> DataFrame:
    """The last timestamp of each of ``points`` equal parts of the grid."""
    grid = rows.select("ts").distinct()
    order = Window.orderBy("ts")
    return grid.withColumn("_part", F.ntile(points).over(order)).groupBy("_part").agg(F.max("ts").alias("ts")).select("ts")


def resolve_range(first: Column, last: Column, months: int) -> Column:
    """From and to of a request: swapped if reversed, and no longer than so many months back."""
    low, high = F.least(first, last), F.greatest(first, last)
    return F.struct(F.greatest(low, F.add_months(high, -months).cast("timestamp")).alias("from_ts"), high.alias("to_ts"))
