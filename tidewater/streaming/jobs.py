"""Structured Streaming: bars from ticks, activity windows, sessions, late data, upserts, stateful filters and joins.

Each takes a streaming DataFrame (or a static one, where Spark runs the same plan in batch) and returns one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def tick_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """event_id, ts, asset, value from event files as they arrive."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).parquet(folder).select("event_id", "ts", F.col("event_type").alias("asset"), "value")


def bars(ticks: DataFrame, span: str = "1 hour", late: str = "6 hours") -> DataFrame:
    """Tumbling OHLCV bars; ticks later than the watermark are dropped."""
    own = F.struct("ts", "event_id")
    rows = ticks.withWatermark("ts", late).groupBy(F.window("ts", span), "asset").agg(
        F.min_by("value", own).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", own).alias("close"), F.count(F.lit(1)).alias("volume")
    )
    return rows.select("asset", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def activity(ticks: DataFrame, span: str = "6 hours", slide: str = "1 hour", late: str = "6 hours") -> DataFrame:
    """Ticks and value in sliding windows."""
    rows = ticks.withWatermark("ts", late).groupBy(F.window("ts", span, slide), "asset").agg(F.count(F.lit(1)).alias("ticks"), F.sum("value").alias("total"))
    return rows.select("asset", F.col("window.start").alias("ts"), "ticks", "total")


def sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "6 hours") -> DataFrame:
    """Runs of ticks of an asset without a gap."""
    rows = ticks.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "asset").agg(F.count(F.lit(1)).alias("ticks"))
    return rows.select("asset", F.col("session_window.start").alias("first_ts"), F.col("session_window.end").alias("end_ts"), "ticks")


def deduplicated(ticks: DataFrame, late: str = "6 hours") -> DataFrame:
    """Each event once, if it repeats within the watermark."""
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def enriched(ticks: DataFrame, assets: DataFrame) -> DataFrame:
    """Ticks with the columns of the asset dimension, a static table."""
    return ticks.join(assets, "asset", "left")


def outcomes(forecasts: DataFrame, ticks: DataFrame, span: str = "INTERVAL 1 HOUR") -> DataFrame:
    """Forecasts (asset, made_at, predicted) with the ticks of the hour after: a stream-stream join inside watermarks.

    Rows meet by asset and stretch of time, each as long as ``span``: a tick is in one stretch, a forecast in all that its span touches. By the asset alone every
    forecast would be held against every tick of the asset."""
    long = f"greatest(1, unix_micros(timestamp_seconds(0) + {span}))"
    at = lambda x: f"unix_micros({x}) div {long}"
    f = forecasts.withWatermark("made_at", "6 hours").select(F.col("asset").alias("_a"), "made_at", "predicted", F.expr(f"explode(sequence({at('made_at')}, {at(f'made_at + {span}')}))").alias("_s"))
    own = ticks.withWatermark("ts", "6 hours").withColumn("_t", F.expr(at("ts")))
    return f.join(own, F.expr(f"_a = asset AND _s = _t AND ts > made_at AND ts <= made_at + {span}")).select("asset", "made_at", "predicted", "ts", "value")


def write_upserts(stream: DataFrame, path: str, keys: list[str], part: str, newest: list[Column], checkpoint: str, **options: str):
    """Writes each batch over what the table holds at the same keys: the rows of a batch win, of a batch's own rows the first in the order ``newest``.

    The table is partitioned by ``part``, which a key never changes, and only partitions that a batch touches are read and written. A batch is merged into a folder of
    its own first, named by its number: if it runs again, be it that it had stopped half way through the partitions, the same rows are put in their place."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stage = f"{path}-stage/batch={number}"
        if not _exists(spark, f"{stage}/_SUCCESS"):
            first = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest))
            fresh = batch.withColumn("_n", first).where("_n = 1").drop("_n")
            if _exists(spark, path):
                touched = [r[0] for r in fresh.select(part).distinct().collect()]  # the partitions of one batch
                old = spark.read.schema(batch.schema).parquet(path).where(F.col(part).isin(touched))
                fresh = old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)
            fresh.write.mode("overwrite").parquet(stage)
        rows = spark.read.schema(batch.schema).parquet(stage)
        rows.repartition(part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
        if number:
            _delete(spark, f"{path}-stage/batch={number - 1}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).options(**options).trigger(availableNow=True).outputMode("update").start()


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    system, at = _file(spark, path)
    return system.exists(at)


def _delete(spark: SparkSession, path: str) -> None:
    system, at = _file(spark, path)
    system.delete(at, True)


def in_order(rows: DataFrame, keys: list[str], values: list[str], out: list[str], start: list[float], step, late: str) -> DataFrame:
    """keys, ts and the columns ``out``, all doubles, of a walk over each key's rows (keys, ts, values) in event-time order, whatever order they arrive in.

    step(own, values) gives the next state and the row to emit, or None. The state holds own and the rows that the watermark, ``late`` behind the newest, hasn't
    reached: a timer at the first of these walks on when it does. Rows later than the watermark are dropped, so what waits is bounded by it."""
    kinds = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own, waiting = ([*state.get[0]], [[*r] for r in state.get[1]]) if state.exists else ([*start], [])
        for batch in batches:
            waiting += batch[["_at", *values]].astype(float).to_numpy().tolist()
        now = state.getCurrentWatermarkMs()
        waiting.sort()
        ready = sum(r[0] // 1000 <= now for r in waiting)
        found = []
        for at, *row in waiting[:ready]:
            own, made = step(own, row)
            if made is not None:
                found.append((*key, int(at), [float(x) for x in made]))
        waiting = waiting[ready:]
        state.update(([float(x) for x in own], waiting))
        if waiting:
            state.setTimeoutTimestamp(max(now + 1, int(waiting[0][0] // 1000)))
        yield pd.DataFrame(found, columns=[*keys, "_at", "_out"])

    marked = rows.withWatermark("ts", late).select(*keys, "ts", F.unix_micros("ts").alias("_at"), *values)
    walked = marked.groupBy(*keys).applyInPandasWithState(run, f"{kinds}, _at long, _out array<double>", "own array<double>, waiting array<array<double>>", "append", GroupStateTimeout.EventTimeTimeout)
    return walked.select(*keys, F.timestamp_micros("_at").alias("ts"), *[F.col("_out")[k].alias(c) for k, c in enumerate(out)])


def quality_filter(ticks: DataFrame, most: float = 5.0) -> DataFrame:
    """Ticks whose value doesn't jump by more than a factor from the last kept one of their asset; the state is that value."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(batches).sort_values(["ts", "event_id"])
        kept = []
        for value in rows["value"]:
            fine = value > 0 and (last is None or 1 / most <= value / last <= most)
            last = value if fine else last
            kept.append(fine)
        if last is not None:
            state.update((last,))
        yield rows[kept][["event_id", "ts", "asset", "value"]]

    return ticks.groupBy("asset").applyInPandasWithState(run, "event_id long, ts timestamp, asset string, value double", "last double", "append", GroupStateTimeout.NoTimeout)


def crossing_detector(closes: DataFrame, least: float = 0.5, late: str = "6 hours") -> DataFrame:
    """a, b, ts, direction, spread_before, spread_after: changes of sign between large spreads of each pair (a, b, ts, ca, cb), both curves
    from 100 at the pair's first point; the state is that point and the last spread that counts."""

    def step(own: list[float], row: list[float]):
        first_a, first_b, last = own if own else [*row, 0.0]
        spread, made = 100 * row[0] / first_a - 100 * row[1] / first_b, None
        if last * spread < 0:
            if abs(spread) >= least and abs(last) >= least:
                made = (float(spread > 0), last, spread)
            last = spread
        elif abs(spread) >= least:
            last = spread
        return [first_a, first_b, last], made

    found = in_order(closes, ["a", "b"], ["ca", "cb"], ["direction", "spread_before", "spread_after"], [], step, late)
    return found.withColumn("direction", F.col("direction").cast("int"))


def hedge_weights(outcomes_: DataFrame, models: list[str], keys: list[str], late: str = "6 hours", eta: float = 0.5, floor: float = 0.01, penalty: float = 1.2) -> DataFrame:
    """keys, ts and a column a model: the models' weights after each outcome (keys, ts, actual, one column for each model); the state is the weights."""

    def step(own: list[float], row: list[float]):
        actual, shrunk = row[0], []
        for w, p in zip(own, row[1:], strict=True):
            loss = min(4.0, abs(p - actual) / max(0.002, 2 * abs(actual)))
            wrong = abs(actual) > 1e-5 and (abs(p) < 1e-4 or (p > 0) != (actual > 0))
            shrunk.append(w * math.exp(-eta * (loss + penalty * wrong)))
        lifted = [max(floor, w / sum(shrunk)) for w in shrunk]
        weights = [w / sum(lifted) for w in lifted]
        return weights, weights

    return in_order(outcomes_, keys, ["actual", *models], models, [1.0 / len(models)] * len(models), step, late)


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all files there are, into parquet files, and reads the result."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
