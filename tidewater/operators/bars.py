"""Bars: merging, upserts, cleaning and quality reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.series import log_return, own

#: Largest believable factor between closes, by interval.
JUMP = {"1d": 10.0, "1h": 5.0}


def merge_bars(rows: DataFrame) -> DataFrame:
    """One bar for each asset and ts from rows with open, high, low, close, volume and ord: the first open, highest
    high, lowest low, last close and summed volume (null as 0)."""
    return rows.groupBy("asset", "ts").agg(
        F.min_by("open", "ord").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "ord").alias("close"), F.sum(F.coalesce("volume", F.lit(0.0))).alias("volume"),
    )


def snap(ts: Column, interval: str) -> Column:
    """The UTC day or hour that ts falls in."""
    return F.date_trunc("day" if interval == "1d" else "hour", ts)


def last_of_batch(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).where(F.col("_n") == 1).drop("_n")


def stamped(rows: DataFrame, at: Column) -> DataFrame:
    """rows with ingested: when they were taken in."""
    return rows.withColumn("ingested", at)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new put in place: new wins wherever a key is in both. Keys are unique in either."""
    values = [c for c in old.columns if c not in keys]
    both = old.select(*keys, F.struct(*values).alias("_old")).join(new.select(*keys, F.struct(*values).alias("_new")), keys, "full_outer")
    return both.select(*keys, *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) for c in values])


def upsert_keeping(old: DataFrame, new: DataFrame, keys: list[str], replaced: tuple[str, ...] = ()) -> DataFrame:
    """As upsert, but a null in new keeps the old value, save in the columns of ``replaced``."""
    values = [c for c in old.columns if c not in keys]
    both = old.select(*keys, F.struct(*values).alias("_old")).join(new.select(*keys, F.struct(*values).alias("_new")), keys, "full_outer")

    def merged(c: str) -> Column:
        if c in replaced:
            return F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))
        return F.coalesce(f"_new.{c}", f"_old.{c}")

    return both.select(*keys, *[merged(c).alias(c) for c in values])


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of new, one for each key, whose key isn't in old."""
    return new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")


def incremental_range(known: DataFrame, wanted: DataFrame, overlap: str, back: str) -> DataFrame:
    """asset, from_ts, to_ts: from the last known bar less an overlap, or so far back if none is known."""
    last = known.groupBy("asset").agg(F.max("ts").alias("last_ts"))
    to = wanted.agg(F.max("ts").alias("to_ts"))
    return wanted.select("asset").distinct().join(last, "asset", "left").join(F.broadcast(to)).select("asset", F.coalesce(F.expr(f"last_ts - INTERVAL {overlap}"), F.expr(f"to_ts - INTERVAL {back}")).alias("from_ts"), "to_ts")


def top_of_class(assets: DataFrame, n: int) -> DataFrame:
    """Each asset with its place in its class (rank nulls last, then rank, then capitalisation) and whether it is in the top n."""
    order = Window.partitionBy("cls").orderBy(F.col("cap_rank").asc_nulls_last(), F.desc("market_cap"), "asset")
    return assets.withColumn("place", F.row_number().over(order)).withColumn("is_tracked", F.col("place") <= n)


def flag_outliers(bars: DataFrame, most: float) -> DataFrame:
    """bars with kept and factor: a close that jumps by more than ``most`` against the last kept one is dropped,
    unless the following bar confirms the new level; closes that aren't positive are dropped. The rule depends on
    what was kept before, so each asset's closes are walked in order, with the last kept one as the only state."""

    def inside(x: float) -> bool:
        return 1 / most <= x <= most

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ts")
        closes, anchor, kept, factors = part["close"].to_list(), None, [], []
        for close, after in zip(closes, [*closes[1:], None], strict=True):
            factor = None if anchor is None else close / anchor
            confirmed = after is not None and after > 0 and close > 0 and inside(after / close)
            fine = bool(close > 0 and (factor is None or inside(factor) or confirmed))
            kept.append(fine)
            factors.append(max(factor, 1 / factor) if factor else None)
            anchor = close if fine else anchor
        return part.assign(kept=kept, factor=pd.Series(factors, index=part.index, dtype="float64"))

    return bars.groupBy("asset").applyInPandas(run, T.StructType([*bars.schema.fields, T.StructField("kept", T.BooleanType()), T.StructField("factor", T.DoubleType())]))


def quality_report(flagged: DataFrame, suspicious: float = 0.02) -> DataFrame:
    """Kept and rejected bars of each asset, the worst factor, the share rejected."""
    report = flagged.groupBy("asset").agg(F.count_if("kept").alias("n_kept"), F.count_if(~F.col("kept")).alias("n_rejected"), F.max("factor").alias("worst"))
    share = F.col("n_rejected") / (F.col("n_kept") + F.col("n_rejected"))
    return report.withColumn("reject_ratio", share).withColumn("suspicious", share >= suspicious)


def jumpy(bars: DataFrame, most: float, least_jumps: int) -> DataFrame:
    """Assets with at least so many jumps beyond a factor, and the worst."""
    factor = F.col("close") / F.lag("close").over(own())
    steps = bars.where("close > 0").withColumn("_f", F.greatest(factor, 1 / factor)).where(F.col("_f") > most)
    return steps.groupBy("asset").agg(F.count(F.lit(1)).alias("jumps"), F.max("_f").alias("worst")).where(F.col("jumps") >= least_jumps)


def flat(bars: DataFrame, low: float = 0.9, high: float = 1.1, relative: float = 0.02) -> DataFrame:
    """Assets that look like a stable coin or don't move: mean, relative deviation and the verdict."""
    own_ = bars.groupBy("asset").agg(F.avg("close").alias("mean_close"), F.stddev_samp("close").alias("_sd"))
    rel = F.try_divide(F.col("_sd"), F.col("mean_close"))
    verdict = (F.col("mean_close").between(low, high) & (rel < relative)) | rel.isNull() | (rel < 1e-5) | (F.abs("mean_close") < 1e-9)
    return own_.select("asset", "mean_close", rel.alias("rel_sd"), verdict.alias("is_flat"))


def reference_mismatch(bars: DataFrame, references: DataFrame, most: float = 3.0) -> DataFrame:
    """Assets whose last close is off its reference price by more than a factor."""
    last = bars.groupBy("asset").agg(F.max_by("close", "ts").alias("last_close"))
    factor = F.col("last_close") / F.col("reference_price")
    both = last.join(references, "asset").withColumn("factor", F.greatest(factor, 1 / factor))
    return both.select("asset", "last_close", "reference_price", "factor", (F.col("factor") > most).alias("mismatch"))


def mute(assets: DataFrame, bars: DataFrame, days: int, least: int, collapsed: float = 0.001) -> DataFrame:
    """Why an asset is mute: no bars, stale, too few, or collapsed to a thousandth of its high; null if it isn't."""
    now = bars.agg(F.max("ts").alias("_now"))
    own_ = bars.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts"), F.max_by("close", "ts").alias("_close"), F.max("high").alias("_high"))
    why = (
        F.when(F.col("n").isNull(), "no bars")
        .when(F.col("last_ts") < F.col("_now") - F.expr(f"INTERVAL {days} DAYS"), "stale")
        .when(F.col("n") < least, "too few")
        .when(F.col("_close") <= collapsed * F.col("_high"), "collapsed")
    )
    return assets.select("asset").join(own_, "asset", "left").join(F.broadcast(now)).select("asset", F.coalesce("n", F.lit(0)).alias("n"), why.alias("reason"))


def without(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """The rows of a dependent table that are left once some assets are removed."""
    return rows.join(removed.select("asset"), "asset", "left_anti")


def facet_counts(assets: DataFrame) -> DataFrame:
    """Assets per sector and per region in one pass; nulls are left out."""
    sets = assets.groupingSets([["sector"], ["region"]], "sector", "region").agg(F.count(F.lit(1)).alias("n"), F.grouping("sector").alias("_by_region"))
    return sets.select(F.when(F.col("_by_region") == 0, "sector").otherwise("region").alias("facet"), F.coalesce("sector", "region").alias("value"), "n").where(F.col("value").isNotNull())


def log_returns(bars: DataFrame) -> DataFrame:
    return bars.withColumn("r", log_return(F.col("close"), F.lag("close").over(own())))


def ingest(fetched: DataFrame, stored: DataFrame, most: float) -> tuple[DataFrame, DataFrame]:
    """The table after clean bars of a batch are put over the stored ones, and each asset's bars fetched, rejected and written."""
    flagged = flag_outliers(fetched, most)
    values = ["open", "high", "low", "close", "volume"]
    table = upsert(stored.select("asset", "ts", *values), flagged.where("kept").select("asset", "ts", *values), ["asset", "ts"])
    report = flagged.groupBy("asset").agg(F.count(F.lit(1)).alias("fetched"), F.count_if(~F.col("kept")).alias("rejected"), F.count_if("kept").alias("written"))
    return table, report


def write_track(old: DataFrame, batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The track after a batch: one row of the batch for each key, the first by order, put over the old rows."""
    return upsert(old, last_of_batch(batch, keys, order), keys)
