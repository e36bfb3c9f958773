"""Features for learning: relations between assets, the full feature row, the cross-section matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.series import clamp, last_rows, own

#: Classes of the asset dimension: stock, ETF, crypto, index.
CLASSES = range(4)


def relations(neighbours: DataFrame, leaders: DataFrame, top: int = 8, least: float = 0.05) -> DataFrame:
    """asset, relation, place, other, lag, weight: the ``top`` neighbours with |r| above ``least`` and the ``top`` leaders.

    neighbours: asset, other, r; leaders: asset, leader, lag, lag_corr, place. Equal |r| go by name."""
    order = Window.partitionBy("asset").orderBy(F.desc(F.round(F.abs("r"), 9)), "other")
    near = neighbours.where(F.round(F.abs("r"), 9) > least).withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    near = near.select("asset", F.lit("neighbour").alias("relation"), "place", "other", F.lit(0).alias("lag"), F.col("r").alias("weight"))
    led = leaders.where(F.col("place") <= top).select("asset", F.lit("leader").alias("relation"), "place", F.col("leader").alias("other"), "lag", F.col("lag_corr").alias("weight"))
    return near.unionByName(led)


def feature_rows(flow: DataFrame, related: DataFrame, n_assets: DataFrame, history: int = 70) -> DataFrame:
    """asset, ts, cls and 29 features of each bar with more than ``history`` bars before it.

    flow: bars with cls and gross. related: see relations. n_assets: one row, column n. Missing values count as 0. Class shares
    run over the calendar, one row a day; everything else over the asset's own bars or the rows of one day."""
    c, w = F.col("close"), own()
    rows = flow.select("asset", "ts", "cls", "close", "gross", F.row_number().over(w).alias("i"), *[F.ln(c / F.lag("close", n).over(w)).alias(f"r{n}") for n in (*range(1, 13), 20)])
    day, r = Window.partitionBy("ts"), F.coalesce("r1", F.lit(0.0))
    rows = rows.withColumn("r", r).withColumn("share", F.col("gross") / F.sum("gross").over(day))
    market = market_days(rows, n_assets)
    base = rows.withColumn("cls_r1", F.avg("r").over(Window.partitionBy("ts", "cls")))
    z50, z20, before = last_rows(50), last_rows(20, 1), F.count("gross").over(last_rows(20, 1)) >= 5
    spread, mean_share = F.stddev_samp("gross").over(z20), F.avg("share").over(z20)
    base = base.select(
        "asset", "ts", "cls", "i", "cls_r1", *[f"r{n}" for n in (1, 2, 3, 5, 10, 20)],
        F.stddev_samp("r").over(last_rows(20)).alias("vol20"), F.stddev_samp("r").over(last_rows(60)).alias("vol60"),
        (c / F.avg("close").over(last_rows(20)) - 1).alias("ma20_dist"), (c / F.avg("close").over(z50) - 1).alias("ma50_dist"),
        F.try_divide(F.ln(c) - F.avg(F.ln(c)).over(z50), F.stddev_samp(F.ln(c)).over(z50)).alias("z50"),
        F.when(before, clamp(F.try_divide(F.col("gross") - F.avg("gross").over(z20), spread), -10.0, 10.0)).alias("flow_z20"),
        (10000 * F.col("share")).alias("flow_share_bp"), F.when(before, clamp(F.try_divide(F.col("share"), mean_share) - 1, -10.0, 10.0)).alias("flow_rot20"),
    )
    met = base.where(F.col("i") > history).join(market, "ts").join(signals(rows, related), ["asset", "ts"], "left")

    def of_class(name: str) -> Column:
        return F.element_at(F.array(*[F.col(f"_{name}{k}") for k in CLASSES]), F.col("cls") + 1)

    met = met.withColumn("cls_share", of_class("s")).withColumn("cls_rot", of_class("q")).withColumn("rel_str20", F.col("r20") - F.col("_m20"))
    for k, name in enumerate(("is_stock", "is_etf", "is_crypto")):
        met = met.withColumn(name, (F.col("cls") == k).cast("double"))
    kept = [x for x in met.columns if not x.startswith("_") and x not in ("asset", "ts", "cls", "i")]
    return met.select("asset", "ts", "cls", *[F.coalesce(x, F.lit(0.0)).alias(x) for x in kept])


def market_days(rows: DataFrame, n_assets: DataFrame) -> DataFrame:
    """The market's state of each day, with each class's share, its rotation and the market's last 20 days."""
    total = F.sum("gross")
    days = rows.groupBy("ts").agg(
        F.avg("r").alias("mkt_r1"), F.avg("r5").alias("mkt_r5"), F.stddev_samp("r").alias("mkt_disp"), F.avg((F.col("r") > 0).cast("double")).alias("mkt_breadth"), F.count(F.lit(1)).alias("_c"),
        *[F.coalesce(F.try_divide(F.sum(F.when(F.col("cls") == k, F.col("gross"))), total), F.lit(0.0)).alias(f"_s{k}") for k in CLASSES],
    )
    last = Window.orderBy("ts").rowsBetween(-19, 0)
    days = days.join(F.broadcast(n_assets)).withColumn("session_cov", F.col("_c") / F.col("n")).drop("n", "_c").withColumn("_m20", F.sum("mkt_r1").over(last))
    for k in CLASSES:
        days = days.withColumn(f"_q{k}", F.try_divide(F.col(f"_s{k}"), F.avg(f"_s{k}").over(last)) - 1)
    return days


def signals(rows: DataFrame, related: DataFrame) -> DataFrame:
    """asset, ts, nb_r1, nb_r5, lead_signal: returns of the related assets that traded then, weighed by correlation with its sign."""
    lagged = F.element_at(F.array(*[F.col(f"r{n}") for n in range(1, 13)]), F.greatest(F.lit(1), F.col("lag")))
    met = rows.select(F.col("asset").alias("other"), "ts", *[f"r{n}" for n in range(1, 13)]).join(related, "other")
    near, led = F.col("relation") == "neighbour", F.col("relation") == "leader"
    w = F.col("weight")

    def mean(which: Column, value: Column, known: Column) -> Column:
        return F.try_divide(F.sum(F.when(which & known, w * F.coalesce(value, F.lit(0.0)))), F.sum(F.when(which & known, F.abs(w))))

    return met.groupBy("asset", "ts").agg(
        mean(near, F.col("r1"), F.col("r1").isNotNull()).alias("nb_r1"), mean(near, F.col("r5"), F.col("r1").isNotNull()).alias("nb_r5"), mean(led, lagged, lagged.isNotNull()).alias("lead_signal")
    )


def cross_section(returns: DataFrame, assets: DataFrame, coverage: float = 0.9, train: float = 0.6) -> DataFrame:
    """asset, ts, x: the returns of all assets on the days when enough of them have one, missing ones 0, each asset scaled by the mean and
    deviation of the first ``train`` of these days. An asset that never moves there keeps 0.

    returns: asset, ts, r (null: none). assets: asset, the dimension that the matrix has a column for each of."""
    n = assets.agg(F.count(F.lit(1)).alias("_all"))
    days = returns.groupBy("ts").agg(F.count("r").alias("_n")).join(F.broadcast(n)).where(F.col("_n") >= coverage * F.col("_all"))
    days = days.select("ts", ((F.row_number().over(Window.orderBy("ts")) - 1) / F.count(F.lit(1)).over(Window.partitionBy())).alias("_p"))
    dense = days.crossJoin(assets.select("asset")).join(returns, ["asset", "ts"], "left").withColumn("r", F.coalesce("r", F.lit(0.0)))
    known, whole = F.when(F.col("_p") < train, F.col("r")), Window.partitionBy("asset")
    scaled = F.try_divide(F.col("r") - F.avg(known).over(whole), F.stddev_pop(known).over(whole))
    return dense.select("asset", "ts", F.coalesce(scaled, F.lit(0.0)).alias("x"))


def feature_matrix(features: DataFrame, targets: DataFrame) -> DataFrame:
    """Feature rows beside their targets (asset, ts, y_h*), without rows that have no target at all; to be written as CSV or Parquet."""
    names = [c for c in targets.columns if c.startswith("y_h")]
    return features.join(targets, ["asset", "ts"]).where(F.coalesce(*names).isNotNull())
