"""Synthetic series with known answers, and a sample of the registered queries against their SQL."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.operators import align, bars, curve, flow, forecast, pairs, portfolio, spectral
from tidewater.plans import ORACLE_SQL, QUERIES


def series(spark, *closes, names="ABCDEFGH"):
    rows = [(names[k], f"2024-01-{1 + i:02d}" if i < 31 else f"2024-02-{i - 30:02d}", float(c)) for k, one in enumerate(closes) for i, c in enumerate(one) if c is not None]
    df = spark.createDataFrame(rows, "asset string, ts string, close double").withColumn("ts", F.to_timestamp("ts"))
    return df.select("asset", "ts", *[F.col("close").alias(c) for c in ("open", "high", "low")], "close", F.lit(1.0).alias("volume"))


def test_spike_is_dropped_and_revaluation_kept(spark):
    flags = {(r["asset"], r["ts"].day): r["kept"] for r in bars.flag_outliers(series(spark, [10, 10, 10000, 10, 11], [10, 10, 200, 210, 190], [-1, 10, 60, 10, 0]), 10.0).collect()}
    assert [flags["A", d] for d in range(1, 6)] == [True, True, False, True, True]
    assert all(flags["B", d] for d in range(1, 6))
    assert [flags["C", d] for d in range(1, 6)] == [False, True, True, True, False]
    strict = bars.flag_outliers(series(spark, [10, 70, 10]), 5.0).where("NOT kept").count()
    assert strict == 1


def test_removal_takes_every_asset_that_jumps_beyond_twenty(spark, tmp_path):
    """Jumps between 20 and 300 count; two of them, or steps of exactly 20, don't remove an asset."""
    closes = {"calm": [10, 11, 10, 11, 10], "wild": [1, 1000, 1, 1000, 1], "some": [10, 300, 10, 300, 300], "few": [10, 300, 10, 10, 10], "edge": [10, 200, 10, 200, 10]}
    parts = pd.DataFrame({"p_partkey": range(len(closes)), "p_brand": list(closes), "p_type": "x"})
    rows = [(10 * k + i, 1, k, 1, 2.0, 2.0 * c, pd.Timestamp("2024-01-01") + pd.Timedelta(days=i)) for k, one in enumerate(closes.values()) for i, c in enumerate(one)]
    lines = pd.DataFrame(rows, columns=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]).astype({"l_shipdate": "datetime64[us]"})
    db = duckdb.connect()
    for table, df in (("part", parts), ("lineitem", lines)):
        db.register(table, df).execute(f"COPY {table} TO '{tmp_path}/{table}.parquet'")
    got = sorted((r["asset"], r["ts"].day, r["close"]) for r in QUERIES["b9_cascade_removal"](spark, str(tmp_path)).collect())
    assert got == sorted((a, i + 1, float(c)) for a in ("calm", "few", "edge") for i, c in enumerate(closes[a]))
    assert got == sorted((a, ts.day, close) for a, ts, close in db.sql(ORACLE_SQL["b9_cascade_removal"]).fetchall())


def test_movers_from_a_price_of_zero(spark, tmp_path):
    """A zero among the closes or lows gives what the SQL gives, infinite or NaN, and no error; so does a missing or a single price."""
    closes = {"low": [5, 4, 0, 4, 5, 6], "last": [1, 2, 3, 4, 0, 6], "sixth": [0, 2, 3, 4, 5, 6], "both": [0, 2, 3, 4, 0, 0], "end": [1, 2, 3, 4, 5, 0], "minus": [1, 2, 3, 4, 0, -6], "old": [0, 1, 2, 3, 4, 5, 6], "one": [7], "none": [1, None, 3], "zero": [0]}
    closes |= {f"many{k:02}": [1, 2, 3, 4, 0, 6] for k in range(14)}
    rows = [(100 * k + i, pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i), 1, asset, v, "") for k, (asset, own) in enumerate(closes.items()) for i, v in enumerate(own)]
    events = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"]).astype({"ts": "datetime64[us]", "value": "float64"})
    db = duckdb.connect()
    db.register("frame", events).execute(f"COPY (SELECT * REPLACE (CASE WHEN isnan(value) THEN NULL ELSE value END AS value) FROM frame) TO '{tmp_path}/events.parquet'")
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got, want = ([tuple(map(str, r)) for r in found] for found in (QUERIES["m9_hourly_movers"](spark, str(tmp_path)).collect(), db.sql(ORACLE_SQL["m9_hourly_movers"]).fetchall()))
    assert got == want and len(got) == 20
    assert {"nan", "inf", "-inf"} <= {x for r in got for x in r}


def test_correlation_and_lag(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=40)
    rows = [("a", "b", i, float(x[i]), float(x[i - 2]) if i > 1 else 0.0) for i in range(40)]
    found = pairs.best_lag(pairs.cross_correlation(spark.createDataFrame(rows, "a string, b string, ts long, ra double, rb double"), 5)).first()
    assert found["lag"] == 2 and found["r"] > 0.9
    flat = spark.createDataFrame([("a", "b", i, 1.0, float(i)) for i in range(5)], "a string, b string, ts long, x double, y double")
    from tidewater.functions.series import correlation

    assert flat.groupBy("a").agg(correlation("x", "y").alias("r")).first()["r"] == 0


def test_crossing_once_and_none(spark):
    up = series(spark, [100, 101, 103, 104, 106], [100, 104, 103.6, 103, 102])
    assert pairs.crossings(align.pair_join(up)).count() == 1
    calm = series(spark, [100, 100.2, 100.1, 100.3], [100, 100.1, 100.2, 100.1])
    assert pairs.crossings(align.pair_join(calm)).count() == 0


def test_fill_rebase_intersect(spark):
    own = series(spark, [None, 2, None, 4], [1, 2, 3, 4])
    filled = {(r["asset"], r["ts"].day): r["filled"] for r in align.forward_fill(align.densify(own)).collect()}
    assert filled["A", 1] is None and filled["A", 3] == 2 and filled["B", 3] == 3
    assert align.intersect_series(own).count() == 4
    assert [r["rebased"] for r in align.rebase(series(spark, [0, 2, 3])).orderBy("ts").collect()] == [0, 100, 150]


def test_as_of_is_at_or_before(spark):
    own = series(spark, [1, None, 3])
    probes = spark.createDataFrame([("A", "2023-12-31"), ("A", "2024-01-02"), ("A", "2024-01-20")], "asset string, d string").select("asset", F.to_timestamp("d").alias("asked"))
    assert [r["close"] for r in align.as_of(probes, own, 4).orderBy("asked").collect()] == [None, 1.0, None]


def test_weights_sum_to_one_and_keep_the_floor(spark):
    rng = np.random.default_rng(1)
    made = forecast.forecasts(series(spark, list(100 * np.exp(np.cumsum(rng.normal(0.01, 0.002, 50))))), (1,))
    weights = {r["model"]: r["weight"] for r in forecast.learned_weights(made).collect()}
    assert abs(sum(weights.values()) - 1) < 1e-9 and min(weights.values()) > 0.009 and weights["naive"] < weights["drift"]


def test_models_on_too_short_a_past_say_nothing(spark):
    made = forecast.forecasts(series(spark, [1, 2, 3]), (1,)).collect()
    assert all(r["drift"] == r["momentum"] == r["meanrev"] == 0 for r in made)


def test_thinning_keeps_a_gap(spark):
    events = spark.createDataFrame([("A", i, "x") for i in (1, 3, 8, 12, 13)], "asset string, i long, what string")
    assert [r["i"] for r in curve.thinned(events, 5).orderBy("i").collect()] == [1, 8, 13]


def test_spectrum_finds_a_sine(spark):
    rows = spark.createDataFrame([("A", i, math.sin(2 * math.pi * i / 16)) for i in range(512)], "asset string, i long, x double")
    found = spectral.summary(spectral.welch(spectral.fourier(rows, range(12, 129), 128)), 128).first()
    assert abs(found["period"] - 16) < 0.5 and found["prominence"] > 10


def test_ssa_continues_a_cycle():
    x = np.sin(2 * np.pi * np.arange(200) / 20) + 0.01 * np.arange(200)
    path, share = spectral.ssa_forecast(x, 50, 4, 20)
    truth = np.sin(2 * np.pi * np.arange(200, 220) / 20) + 0.01 * np.arange(200, 220)
    assert np.abs(path - truth).mean() < np.abs(x[-1] - truth).mean() / 3 and share > 0.9


def test_tiles_are_those_of_one_window(spark):
    rng = np.random.default_rng(3)
    rows = [(f"A{i % 7}", i, float(rng.integers(0, 40)) if i % 3 else 1.0, int(i % 2)) for i in range(503)]
    df = spark.createDataFrame(rows, "asset string, ts long, x double, g int")
    for by in ((), ("g",)):
        want = df.withColumn("tile", F.ntile(5).over(Window.partitionBy(*by).orderBy("x", "asset", "ts")))
        assert sorted(map(tuple, flow.with_tile(df, "x", "tile", by).select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    few = flow.with_tile(df.limit(3), "x", "tile").collect()
    assert sorted(r["tile"] for r in few) == [1, 2, 3] and flow.with_tile(df.limit(0), "x", "tile").count() == 0


def test_walk_forward_learns_only_what_has_arrived(spark):
    rng = np.random.default_rng(5)
    closes = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 55)))
    changed = closes.copy()
    changed[45:] *= 1.5
    one, two = ([{r["rn"]: r["combined"] for r in forecast.walk_forward(forecast.forecasts(series(spark, c), (5,)), 20).collect()}] for c in (closes, changed))
    early = [n for n in one[0] if n <= 45]
    assert early and all(one[0][n] == pytest.approx(two[0][n], abs=1e-12) for n in early)
    assert any(abs(one[0][n] - two[0][n]) > 1e-9 for n in one[0] if n > 45)


def test_cycle_of_a_sine(spark):
    rows = spark.createDataFrame([("A", i, math.sin(2 * math.pi * i / 20)) for i in range(300)] + [("B", i, 1.0) for i in range(30)], "asset string, ts long, band double")
    found = spectral.instant_cycle(rows).collect()
    assert [r["asset"] for r in found] == ["A"] and abs(found[0]["period"] - 20) < 2 and abs(found[0]["amplitude"] - 1) < 0.15
    path = [r["projected"] for r in spectral.cycle_projection(spectral.instant_cycle(rows), 20).orderBy("step").collect()]
    assert np.corrcoef(path, np.array([math.sin(2 * math.pi * (300 + i) / 20) for i in range(20)]))[0, 1] > 0.7


def test_patterns_match_across_assets_with_their_lag(spark):
    rng = np.random.default_rng(1)
    rows = [(a, i, math.cos(2 * math.pi * (i - shift) / 32) + 0.2 * float(rng.normal())) for a, shift in (("A", 0), ("B", 4)) for i in range(1600)]
    waves = spark.createDataFrame(rows, "asset string, i long, x double")
    found = spectral.frequency_patterns(waves, spectral.fourier(waves, range(5, 103), 128), 128, peaks=1)
    matches = spectral.match_patterns(found).collect()
    assert matches and abs(np.median([abs(m["lag"]) for m in matches]) - 4) < 1 and all(m["a"] == "A" and m["b"] == "B" for m in matches)
    again = spectral.recurring_pairs(spectral.match_patterns(found), 2).collect()
    assert len(again) == 1 and again[0]["epochs"] == len({m["epoch"] for m in matches})


def test_conserved_group_is_found(spark):
    rng = np.random.default_rng(2)
    steps = np.cumsum(rng.normal(size=(400, 8)), axis=0)
    steps[:, 2] = -(steps[:, 0] + steps[:, 1])
    rows = [(f"A{k}", f"2020-01-01 {t // 60:02d}:{t % 60:02d}:00", float(steps[t, k])) for t in range(400) for k in range(8)]
    shares = spark.createDataFrame(rows, "asset string, ts string, share double").withColumn("ts", F.to_timestamp("ts"))
    found = flow.conserved_groups(shares, pd.Timestamp("2020-01-01 03:20:00").to_pydatetime(), groups=1).collect()
    assert {"A0", "A1", "A2"} <= {r["asset"] for r in found} and all(r["holds"] and r["out_sample"] < r["chance"] for r in found)


def test_greedy_basket_by_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0.01, 0.05, (60, 6))
    x[:, 1] = x[:, 0] + rng.normal(0, 0.001, 60)
    rows = [(f"A{k}", t, float(x[t, k])) for t in range(60) for k in range(6)]
    found = portfolio.greedy_baskets(spark.createDataFrame(rows, "asset string, ts long, r double"), (3,)).orderBy("place").collect()
    own = [int(np.argmax(x.mean(axis=0) / x.std(axis=0, ddof=1)))]
    while len(own) < 3:
        fine = [j for j in range(6) if j not in own and all(np.corrcoef(x[:, j], x[:, g])[0, 1] <= 0.9 for g in own)]
        own.append(min(fine, key=lambda j: x[:, [*own, j]].mean(axis=1).std(ddof=1)))
    assert [r["asset"] for r in found] == [f"A{k}" for k in own]
    assert found[0]["deviation"] == pytest.approx(x[:, own].mean(axis=1).std(ddof=1))


SAMPLE = ["a11_ingest", "b3_outlier_filter", "c14_nearest_event", "g16_similar_shapes", "h2_band_pass", "j2_feature_rows", "j6_cross_section", "k26_walk_forward", "k31_verdict_contribution", "k32_verdict_scoring", "f16_overhang_quintiles", "f17_double_sort", "a3_bar_upsert", "b2_bar_merge", "c8_as_of_close", "d5_best_lag", "e2_crossings", "f11_flow_attribution", "g1_market_events", "k14_scoring", "l4_trigger_study", "m13_cash_accounts", "n11_lexicon_sentiment", "r1_stream_bars"]


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, sf_dir, name):
    got, db = QUERIES[name](spark, sf_dir).toPandas(), duckdb.connect()
    for table in ("part", "lineitem", "orders", "events", "documents"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = db.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    names = sorted(got.columns)
    sides = [df[names].astype({c: str for c in names if df[c].dtype == object or "datetime" in str(df[c].dtype)}).sort_values(names).reset_index(drop=True) for df in (got, want)]
    pd.testing.assert_frame_equal(*sides, check_dtype=False, atol=1e-3 if name == "f11_flow_attribution" else 1e-5)
