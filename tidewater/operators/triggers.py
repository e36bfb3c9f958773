"""Technical triggers: indicators, crossings of levels and what followed them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.series import last_rows, own


def indicators(bars: DataFrame) -> DataFrame:
    """bars with moving averages, deviation, the year's high before, mean volume before, RSI 14 and their last values.

    RSI is the simple-average variant. All windows share one partitioning, so the table is shuffled once.
    """
    w, c = own(), F.col("close")
    full = lambda n, x: F.when(F.col("rn") >= n, x)
    rows = bars.withColumn("rn", F.row_number().over(w)).withColumn("before", F.lag("close").over(w))
    rows = rows.withColumn("_up", F.greatest(c - F.col("before"), F.lit(0.0))).withColumn("_down", F.greatest(F.col("before") - c, F.lit(0.0)))
    rows = rows.select(
        "*",
        *[full(n, F.avg("close").over(last_rows(n))).alias(f"ma{n}") for n in (20, 50, 200)],
        full(20, F.stddev_samp("close").over(last_rows(20))).alias("sd20"),
        full(253, F.max("close").over(last_rows(252, 1))).alias("high252"),
        full(61, F.avg("volume").over(last_rows(60, 1))).alias("volume60"),
        full(15, F.avg("_up").over(last_rows(14))).alias("_u"),
        full(15, F.avg("_down").over(last_rows(14))).alias("_d"),
    )
    rows = rows.withColumn("rsi", F.when(F.col("_d") == 0, F.when(F.col("_u").isNotNull(), 100.0)).otherwise(100 - 100 / (1 + F.try_divide(F.col("_u"), F.col("_d")))))
    rows = rows.withColumn("gap", F.col("ma50") - F.col("ma200"))
    return rows.withColumn("gap_before", F.lag("gap").over(w)).withColumn("rsi_before", F.lag("rsi").over(w)).withColumn("volume_factor", F.try_divide(F.col("volume"), F.col("volume60"))).drop("_up", "_down", "_u", "_d")


def conditions() -> list[tuple[str, int, Column]]:
    """Name, direction and test of each trigger, on a row of indicators."""
    c = F.col
    up, down = c("ma20") + 2 * c("sd20"), c("ma20") - 2 * c("sd20")
    return [
        ("golden_cross", 1, (c("gap_before") <= 0) & (c("gap") > 0)),
        ("death_cross", -1, (c("gap_before") >= 0) & (c("gap") < 0)),
        ("rsi_low", 1, (c("rsi_before") >= 30) & (c("rsi") < 30)),
        ("rsi_high", -1, (c("rsi_before") <= 70) & (c("rsi") > 70)),
        ("band_up", 1, (c("close") > up) & (c("before") <= up)),
        ("band_down", -1, (c("close") < down) & (c("before") >= down)),
        ("year_high", 1, (c("close") > c("high252")) & (c("before") <= c("high252"))),
    ]


def triggers(indicated: DataFrame) -> DataFrame:
    """asset, ts, kind, direction, volume_factor and the row's forward returns, from one scan of the indicators."""
    fired = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(k).alias("kind"), F.lit(d).alias("direction"))) for k, d, test in conditions()]))
    return indicated.select("*", F.explode(fired).alias("_t")).select("*", "_t.kind", "_t.direction").drop("_t")


def with_forward(indicated: DataFrame, spans: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    return indicated.select("*", *[(F.lead("close", n).over(own()) / F.col("close") - 1).alias(f"fwd{n}") for n in spans])


def active(found: DataFrame, days: int) -> DataFrame:
    """The triggers of the last ``days`` days of the data."""
    now = found.agg(F.max("ts").alias("_now"))
    return found.join(F.broadcast(now)).where(F.col("ts") >= F.col("_now") - F.expr(f"INTERVAL {days} DAYS")).drop("_now")


def study(indicated: DataFrame, classes: DataFrame, spans: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """Each trigger and class: events, assets, median forward returns against those of all days of the class, hit rate."""
    rows = with_forward(indicated, spans).join(classes.select("asset", "cls"), "asset")
    medians = lambda prefix: [F.percentile(f"fwd{n}", F.lit(0.5)).alias(f"{prefix}{n}") for n in spans]
    base = rows.groupBy("cls").agg(*medians("base"))
    hit = F.when(F.col("fwd5").isNotNull(), (F.signum("fwd5") == F.col("direction")).cast("double"))
    found = triggers(rows).groupBy("cls", "kind").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("asset").alias("assets"), *medians("median"), F.avg(hit).alias("hit_rate"), F.percentile("volume_factor", F.lit(0.5)).alias("volume_factor"))
    return found.join(base, "cls")


def report(studied: DataFrame, spans: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    """The study with each median's excess over the baseline."""
    return studied.select("cls", "kind", "events", "hit_rate", *[(F.col(f"median{n}") - F.col(f"base{n}")).alias(f"excess{n}") for n in spans], (1.96 / F.sqrt("events")).alias("threshold"))
