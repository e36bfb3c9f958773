"""Streams (R of the inventory), drained over the events file and compared with the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import align
from tidewater.operators.forecast import MODELS
from tidewater.sources import tables as t
from tidewater.sources.staging import new_folder
from tidewater.streaming import jobs

from . import forecast as fc
from .registry import query, rounded


def drained(spark, stream):
    at = new_folder(spark, "stream")
    return jobs.drained(stream, f"{at}/out", f"{at}/checkpoint")


def ended(name: str) -> str:
    """A window leaves the stream once the watermark, six hours behind the newest tick, has passed its end."""
    return f"{name} <= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR"


@query("r1_stream_bars", f"WITH {t.HOURLY_SQL} SELECT asset, ts, open, high, low, close, CAST(volume AS BIGINT) AS volume FROM bars WHERE {ended('ts + INTERVAL 1 HOUR')}")
def stream_bars(spark, sf_dir):
    return drained(spark, jobs.bars(jobs.tick_stream(spark, sf_dir)))


@query("r2_stream_activity", f"""WITH w AS (SELECT event_type AS asset, CAST(date_trunc('hour', e.ts) AS TIMESTAMP) - k * INTERVAL 1 HOUR AS ts, value FROM events e CROSS JOIN (SELECT unnest(range(0, 6)) AS k))
    SELECT asset, ts, count(*) AS ticks, round(sum(value), 4) AS total FROM w WHERE {ended('w.ts + INTERVAL 6 HOUR')} GROUP BY 1, 2""")
def stream_activity(spark, sf_dir):
    return rounded(drained(spark, jobs.activity(jobs.tick_stream(spark, sf_dir))), 4)


@query("r3_stream_sessions", f"""WITH g AS (SELECT event_type AS asset, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT asset, ts, sum(n) OVER (PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
    q AS (SELECT asset, min(ts) AS first_ts, max(ts) + INTERVAL 30 MINUTE AS end_ts, count(*) AS ticks FROM s GROUP BY asset, k) SELECT asset, first_ts, end_ts, ticks FROM q WHERE {ended('end_ts')}""")
def stream_sessions(spark, sf_dir):
    return drained(spark, jobs.sessions(jobs.tick_stream(spark, sf_dir)))


@query("r4_stream_dedup", "SELECT DISTINCT event_id, ts, event_type AS asset, value FROM events")
def stream_dedup(spark, sf_dir):
    return drained(spark, jobs.deduplicated(jobs.tick_stream(spark, sf_dir)))


@query("r6_stream_quality", """WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, ts, event_type AS asset, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
    g AS (SELECT asset, 0::BIGINT AS i, NULL::DOUBLE AS held, false AS fine FROM (SELECT DISTINCT asset FROM e) UNION ALL
      SELECT asset, i, CASE WHEN fine THEN value ELSE held END, fine FROM (SELECT e.asset, e.i, e.value, g.held, e.value > 0 AND (g.held IS NULL OR e.value / g.held BETWEEN 0.2 AND 5) AS fine FROM g JOIN e ON e.asset = g.asset AND e.i = g.i + 1))
    SELECT event_id, ts, asset, value FROM e JOIN g USING (asset, i) WHERE fine""")
def stream_quality(spark, sf_dir):
    return drained(spark, jobs.quality_filter(jobs.tick_stream(spark, sf_dir)))


@query("r10_stream_enriched", "SELECT event_id, ts, event_type AS asset, value, n AS known FROM events JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) USING (event_type)")
def stream_enriched(spark, sf_dir):
    known = t.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("asset")).agg(F.count(F.lit(1)).alias("known"))
    return drained(spark, jobs.enriched(jobs.tick_stream(spark, sf_dir), known)).select("event_id", "ts", "asset", "value", "known")


@query("r9_stream_outcomes", "SELECT f.event_type AS asset, f.ts AS made_at, round(f.value, 6) AS predicted, e.ts, round(e.value, 6) AS value FROM events f JOIN events e ON e.event_type = f.event_type AND e.ts > f.ts AND e.ts <= f.ts + INTERVAL 1 HOUR WHERE f.event_id % 10 = 0")
def stream_outcomes(spark, sf_dir):
    """Every tenth tick stands for a forecast; the ticks of the hour after are its outcomes."""
    ticks = rounded(jobs.tick_stream(spark, sf_dir))  # before the join, as each value is in many of its rows
    made = ticks.where("event_id % 10 = 0").select("asset", F.col("ts").alias("made_at"), F.col("value").alias("predicted"))
    return drained(spark, jobs.outcomes(made, ticks))


@query("r5_stream_upsert", "SELECT event_type AS asset, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, max(ts) AS ts, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def stream_upsert(spark, sf_dir):
    """The newest tick of each asset and hour, kept in a table that each batch of the stream is written over."""
    at = new_folder(spark, "stream")
    ticks = jobs.tick_stream(spark, sf_dir).select("asset", F.date_trunc("hour", "ts").alias("hour"), "ts", "event_id", "value", F.date_format("ts", "yyyy-MM").alias("month"))
    jobs.write_upserts(ticks, f"{at}/table", ["asset", "hour"], "month", [F.desc("ts"), F.desc("event_id")], f"{at}/checkpoint").awaitTermination()
    return spark.read.schema(ticks.schema).parquet(f"{at}/table").select("asset", "hour", "ts", "value")


#: Parts that a table arrives in; the third one comes after the fourth.
PARTS = (0, 1, 3, 2, 4)


def arriving(spark, rows):
    """rows (ts, ...) as a stream of five parts of its time, two of them out of order, and the delay that waits for these, in hours."""
    at = new_folder(spark, "stream")
    ends = rows.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(F.unix_seconds("a"), F.unix_seconds("b")).first()
    first, span = ends[0] or 0, max(1, ((ends[1] or 0) - (ends[0] or 0)) // len(PARTS) + 1)
    parted = rows.withColumn("part", ((F.unix_seconds("ts") - first) / span).cast("int"))
    parted.repartition(len(PARTS), "part").write.partitionBy("part").parquet(f"{at}/parts")
    for k, part in enumerate(PARTS):  # in the order of arrival
        spark.read.schema(rows.schema).parquet(f"{at}/parts/part={part}").write.parquet(f"{at}/in/{k}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{at}/in")
    return stream, 3 * span // 3600 + 1


def late_by(rows: str, column: str) -> str:
    """SQL of the last time that a stream in parts has walked to: the delay behind the newest row."""
    return f"(SELECT max({column}) - to_hours(CAST(3 * ((epoch(max({column}))::BIGINT - epoch(min({column}))::BIGINT) // {len(PARTS)} + 1) // 3600 + 1 AS INT)) FROM {rows})"


HOURLY_PAIRS = f"""WITH {t.HOURLY_SQL}, cl AS (SELECT x.asset AS a, y.asset AS b, x.ts, x.close AS ca, y.close AS cb FROM bars x JOIN bars y ON x.ts = y.ts AND x.asset < y.asset WHERE x.close > 0 AND y.close > 0)"""


@query("r7_stream_crossings", f"""{HOURLY_PAIRS}, sp AS (SELECT a, b, ts, 100 * ca / first_value(ca) OVER w - 100 * cb / first_value(cb) OVER w AS s FROM cl WINDOW w AS (PARTITION BY a, b ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    s1 AS (SELECT *, abs(s) >= 0.5 AS big, max(CASE WHEN abs(s) >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY a, b ORDER BY ts) AS seen FROM sp), s2 AS (SELECT *, coalesce(CASE WHEN sign(s) <> sign(lag(s) OVER (PARTITION BY a, b ORDER BY ts)) THEN 1 ELSE 0 END, 0) AS flip FROM s1 WHERE seen = 1 AND s <> 0),
    s3 AS (SELECT *, sum(flip) OVER (PARTITION BY a, b ORDER BY ts) AS run FROM s2), s4 AS (SELECT *, last_value(CASE WHEN big THEN run END IGNORE NULLS) OVER p AS brun, last_value(CASE WHEN big THEN s END IGNORE NULLS) OVER p AS bs FROM s3 WINDOW p AS (PARTITION BY a, b ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT a, b, ts, CASE WHEN s > 0 THEN 1 ELSE 0 END AS direction, round(bs, 4) AS spread_before, round(s, 4) AS spread_after FROM s4 WHERE flip = 1 AND big AND brun = run - 1 AND ts <= {late_by('cl', 'ts')}""")
def stream_crossings(spark, sf_dir):
    """All crossings of hourly closes that arrive in five parts, up to the watermark: those of the batch operator without its limit a pair."""
    closes = align.pair_join(t.hourly_bars(spark, sf_dir).where("close > 0"))
    stream, hours = arriving(spark, closes)
    return rounded(drained(spark, jobs.crossing_detector(stream, late=f"{hours} hours")), 4)


@query("r8_stream_weights", f"""WITH RECURSIVE {fc.WK}{fc.FC}, {fc.grown()}, oo AS (SELECT asset, h, target_ts, row_number() OVER (PARTITION BY asset, h ORDER BY target_ts) AS i FROM fc WHERE actual_close IS NOT NULL)
    SELECT asset, h, target_ts AS ts, round(w1, 6) AS naive, round(w2, 6) AS drift, round(w3, 6) AS momentum, round(w4, 6) AS meanrev FROM oo JOIN g USING (asset, h, i) WHERE target_ts <= {late_by('oo', 'target_ts')}""")
def stream_weights(spark, sf_dir):
    """The weights of each asset and horizon after each outcome of its forecasts, which arrive in five parts, up to the watermark."""
    made = fc.made(spark, sf_dir).where("actual_close IS NOT NULL")
    rows = made.select("asset", "h", F.col("target_ts").alias("ts"), F.ln(F.col("actual_close") / F.col("close")).alias("actual"), *MODELS)
    stream, hours = arriving(spark, rows)
    return rounded(drained(spark, jobs.hedge_weights(stream, list(MODELS), ["asset", "h"], f"{hours} hours")))
