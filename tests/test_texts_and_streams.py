"""Chunks as spans, sentiment, nearest rows in blocks, ties in fifths, contributions, plans, and streams whose files arrive out of order."""

import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.operators import flow, nearest, pairs, pillars, text
from tidewater.plans import QUERIES
from tidewater.sources import tables
from tidewater.streaming import jobs

# texts -----------------------------------------------------------------------------------------------------------------


def brute_chunks(value, target, overlap, least):
    clean, pieces, at = value.replace("\x00", ""), [], 0
    for k, p in enumerate(clean.split("\n")):
        at += k > 0
        cuts = range(0, len(p), target) if len(p) > 2 * target else [0]
        pieces += [(at + c, min(target, len(p) - c) if len(p) > 2 * target else len(p)) for c in cuts]
        at += len(p)
    out, a, end = [], None, None
    for start, n in pieces:
        held = 0 if a is None else end - a
        if held and held + n + 1 > target:
            out.append((a, end))
            a = start if n >= target else end - min(overlap, held)
        elif not held:
            a = start
        end = start + n
    out.append((a, end))
    return clean, [s for s in out if s[1] - s[0] >= least]


@pytest.mark.parametrize("target,overlap,least", [(1400, 200, 100), (60, 15, 5), (10, 20, 1)])
def test_chunks_are_spans_of_the_text(spark, target, overlap, least):
    rng = random.Random(target)
    texts = ["", "short", "\n\n\n", "a" * 500, "line\n" * 60, "x" * 3000 + "\nend", None, "\x00" * 5 + "nul\x00s between words " * 9, "page one\fpage two " * 40, "\n".join("word " * rng.randrange(0, 40) for _ in range(50))]
    texts += ["\n".join("é" * rng.randrange(0, 3 * target) for _ in range(12)) for _ in range(6)]
    got = {}
    for r in text.chunks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), target, overlap, least).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for k, value in enumerate(texts):
        clean, want = brute_chunks(value, target, overlap, least) if value is not None else ("", [])
        rows = sorted(got.get(k, []), key=lambda r: r["ordinal"])
        assert [(r["char_from"], r["char_to"]) for r in rows] == want
        for r in rows:
            assert r["text"] == clean[r["char_from"] : r["char_to"]] and r["n_chars"] == len(r["text"]) and r["page"] == 1 + clean[: r["char_from"]].count("\f")


def test_only_chunks_of_unknown_content_are_embedded(spark):
    rows = [(1, 0, "same"), (1, 1, "changed"), (2, 0, "moved"), (3, 0, "new")]
    hashed = lambda rows, version: spark.createDataFrame(rows, "doc_id long, ordinal int, text string").withColumn("hash", text.identity(version, F.col("doc_id"), F.col("ordinal"), F.col("text")))
    before = [(1, 0, "same"), (1, 1, "old"), (2, 1, "moved"), (4, 0, "gone")]
    got = {(r["doc_id"], r["ordinal"]) for r in text.to_embed(hashed(rows, "v1"), hashed(before, "v1")).collect()}
    assert got == {(1, 1), (2, 0), (3, 0)}
    assert text.to_embed(hashed(rows, "v2"), hashed(rows, "v1")).count() == 4


def test_sentiment_of_reports(spark):
    words = {**text.POSITIVE, **{w: -v for w, v in text.NEGATIVE.items()}}
    texts = ["Gewinnwarnung: Aktie fällt", "Shares surge to a record", "no profit, never higher", "It did not really end in a crash", "nothing here", None, "Sell-off! a sell-off"]

    def mood(value):
        own, found = [w for w in re.split(r"[^\w\-']+", value.lower()) if len(w) > 1], []
        for i, w in enumerate(own):
            if w in words or w in text.PLAIN:
                v = words.get(w, text.PLAIN.get(w))
                found.append(-v if set(own[max(0, i - 3) : i]) & set(text.NEGATIONS) else v)
        return (max(-1, min(1, sum(found) / len(found))), len(found)) if found else None

    rows = text.sentiment(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(text.LEXICON.items()), "token string, weight double")).collect()
    got = {r["doc_id"]: (pytest.approx(r["mood"]), r["hits"]) for r in rows}
    assert got == {k: mood(v) for k, v in enumerate(texts) if v and mood(v)}


def test_nearest_rows_in_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(i, f"g{i % 5}", np.round(rng.normal(size=6), 1).tolist()) for i in range(200)]
    pool = spark.createDataFrame(rows, "i int, grp string, vector array<double>")
    queries = pool.where("i % 9 = 0").select(F.col("i").alias("q"), F.col("grp").alias("q_grp"), "vector")
    got = nearest.top_products(queries, pool, 7, ["i"], lambda held, q: (held["grp"] != q.q_grp).to_numpy(), blocks=3).collect()
    found = {}
    for r in got:
        found.setdefault(r["q"], {})[r["rank"]] = r["i"], round(r["r"], 9)
    for q, grp, v in rows[::9]:
        want = sorted((-round(float(np.dot(v, w)), 9), i) for i, g, w in rows if g != grp)[:7]
        assert [found[q][k] for k in range(1, 8)] == [(i, -r) for r, i in want]
    assert nearest.top_products(queries.limit(0), pool, 7, ["i"], lambda held, q: np.ones(len(held), bool)).count() == 0


# series ----------------------------------------------------------------------------------------------------------------


def test_fifths_with_a_hot_tie(spark):
    rng = np.random.default_rng(6)
    rows = [(f"A{k % 40}", k // 40, 0.0 if k % 2 else float(rng.normal())) for k in range(8000)]
    df = spark.createDataFrame(rows, "asset string, ts long, x double")
    got = {(r["asset"], r["ts"]): r["fifth"] for r in flow.with_tile(df, "x", "fifth").collect()}
    order = sorted(rows, key=lambda r: (r[2], r[0], r[1]))
    assert got == {(a, ts): 1 + i // 1600 for i, (a, ts, _) in enumerate(order)}


def test_contributions_fade_and_mix(spark):
    effects = spark.createDataFrame([(0, "up", 0.01, 0.60, 0.02, 0.62, 0.04, 0.70), (0, "down", -0.01, 0.40, 0.03, 0.55, 0.01, None)], "cls int, kind string, excess1 double, hit1 double, excess5 double, hit5 double, excess20 double, hit20 double")
    active = spark.createDataFrame([("A", "up", 1, 1), ("A", "up", 1, 2), ("A", "down", -1, 2)], "asset string, kind string, direction int, ts int")
    got = {r["h"]: r for r in pillars.knowledge(active, effects, spark.createDataFrame([("A", 0)], "asset string, cls int"), (1, 3, 20, 50, 90)).collect()}
    assert got[3]["value"] == pytest.approx(0.015) and got[3]["merit"] == pytest.approx(0.5) and got[3]["patterns"] == 2
    assert got[1]["value"] == pytest.approx(0.01) and got[1]["merit"] == pytest.approx(1)  # both speak, each for its own direction
    assert got[50]["merit"] == pytest.approx(min(1, (0.2 * 0.5 - 0.02) / 0.08) / 2) and 90 not in got

    rows = [("A", 1, "learning", 0.02, 100, 0.0), ("A", 1, "knowledge", 0.04, 40, 0.5), ("A", 5, "learning", 0.02, 100, 0.0), ("A", 5, "semantic", 0.06, 0, 0.0), ("A", 9, "learning", 0.02, 0, 1.0), ("A", 9, "deep", 0.04, 0, 1.0), ("B", 1, "learning", 0.02, 100, 1.0), ("B", 1, "deep", 0.05, 50, 1.0)]
    view = {(r["asset"], r["h"]): r for r in pillars.combined_view(spark.createDataFrame(rows, "asset string, h int, pillar string, value double, weight int, merit double")).collect()}
    assert [(view[k]["value"], view[k]["verdict"], view[k]["carried"], view[k]["effective"]) for k in (("A", 1), ("A", 5), ("A", 9), ("B", 1))] == [
        (pytest.approx(0.04), "one", 1, 0.2), (pytest.approx(0.02), "weights", 0, 0.0), (pytest.approx(0.03), "equal", 2, 0.0), (pytest.approx(0.03), "several", 2, 1.5)]
    assert [t["share"] for t in view["B", 1]["trace"]] == pytest.approx([1 / 3, 2 / 3])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_read_bars_once(spark, sf_dir):
    assert "SortAggregate" not in plan(tables.bars(spark, sf_dir)) + plan(tables.hourly_bars(spark, sf_dir))
    for name in ("j2_feature_rows", "a10_feature_matrix", "j3_relations"):
        assert plan(QUERIES[name](spark, sf_dir)).count("lineitem.parquet") <= 4
    for name in ("g16_similar_shapes", "n10_semantic_search"):
        made = plan(QUERIES[name](spark, sf_dir))
        assert "CartesianProduct" not in made and "NestedLoop" not in made


# streams ---------------------------------------------------------------------------------------------------------------


def in_parts(spark, folder, rows, schema, parts, order):
    """A stream of files, each a part of the rows, that arrive in this order."""
    edge = [i * len(rows) // parts for i in range(parts + 1)]
    for k, part in enumerate(order):
        spark.createDataFrame(rows[edge[part] : edge[part + 1]], schema).coalesce(1).write.parquet(f"{folder}/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def hours(n):
    return [t.to_pydatetime() for t in pd.date_range("2024-01-01", periods=n, freq="h")]


def test_stream_finds_the_crossings_of_the_batch(spark, tmp_path):
    rng, at = np.random.default_rng(3), hours(200)
    a, b = (100 * np.exp(np.cumsum(0.02 * rng.normal(size=200))) for _ in range(2))
    rows = [("A", "B", t, float(x), float(y)) for t, x, y in zip(at, a, b, strict=True)]
    schema = "a string, b string, ts timestamp, ca double, cb double"
    want = {(r["ts"], r["direction"], round(r["spread_before"], 9), round(r["spread_after"], 9)) for r in pairs.crossings(spark.createDataFrame(rows, schema), most=1000).collect() if r["ts"] <= at[-1] - pd.Timedelta(hours=90)}
    stream = jobs.crossing_detector(in_parts(spark, tmp_path / "in", rows, schema, 5, (0, 2, 1, 3, 4)), late="90 hours")
    got = jobs.drained(stream, str(tmp_path / "out"), str(tmp_path / "check")).collect()
    assert {(r["ts"], r["direction"], round(r["spread_before"], 9), round(r["spread_after"], 9)) for r in got} == want and len(got) == len(want) > 0


def test_stream_learns_in_order_of_time(spark, tmp_path):
    rng, at, models = np.random.default_rng(5), hours(100), ["m1", "m2", "m3"]
    rows = [("A", t, *map(float, 0.02 * rng.normal(size=4))) for t in at]
    w, want = np.full(3, 1 / 3), {}
    for _, t, actual, *p in rows:
        loss = [min(4, abs(x - actual) / max(0.002, 2 * abs(actual))) + 1.2 * (abs(actual) > 1e-5 and (abs(x) < 1e-4 or np.sign(x) != np.sign(actual))) for x in p]
        w = w * np.exp(-0.5 * np.array(loss))
        w = np.maximum(0.01, w / w.sum())
        w = w / w.sum()
        want[t] = w
    schema = "asset string, ts timestamp, actual double, m1 double, m2 double, m3 double"
    stream = jobs.hedge_weights(in_parts(spark, tmp_path / "in", rows, schema, 5, (1, 0, 2, 4, 3)), models, ["asset"], "45 hours")
    got = {r["ts"]: [r[m] for m in models] for r in jobs.drained(stream, str(tmp_path / "out"), str(tmp_path / "check")).collect()}
    assert got.keys() == {t for t in at if t <= at[-1] - pd.Timedelta(hours=45)}
    assert all(got[t] == pytest.approx(want[t].tolist(), abs=1e-12) for t in got)


def table_of(spark, path):
    return sorted((r["k"], r["v"], r["day"]) for r in spark.read.parquet(path).collect())


def test_upserts_touch_their_partitions_and_may_run_twice(spark, tmp_path):
    schema, path = "k int, v int, at int, day string", str(tmp_path / "table")
    first = [(k, k, 0, f"d{k % 3}") for k in range(9)]
    later = [(1, 100, 1, "d1"), (1, 101, 2, "d1"), (10, 10, 0, "d1")]

    def run(name, rows, checkpoint):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        jobs.write_upserts(stream, path, ["k"], "day", [F.desc("at")], str(tmp_path / checkpoint)).awaitTermination()

    run("one", first, "check")
    kept = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "table").rglob("*.parquet") if "d1" not in p.parent.name}
    run("two", later, "check")
    want = sorted([(k, k, f"d{k % 3}") for k in range(9) if k != 1] + [(1, 101, "d1"), (10, 10, "d1")])
    assert table_of(spark, path) == want
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "table").rglob("*.parquet") if "d1" not in p.parent.name} == kept
    (tmp_path / "check" / "commits" / "1").unlink()  # as if the stream had stopped before it noted the batch as done
    for crc in (tmp_path / "check" / "commits").glob(".1*"):
        crc.unlink()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.write_upserts(stream, path, ["k"], "day", [F.desc("at")], str(tmp_path / "check")).awaitTermination()
    assert table_of(spark, path) == want


def test_quality_filter_keeps_what_a_walk_keeps(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, t, "A", float(v)) for i, (t, v) in enumerate(zip(hours(120), np.exp(rng.normal(size=120)) * np.where(rng.random(120) < 0.1, 50, 1) * np.where(rng.random(120) < 0.05, -1, 1), strict=True))]
    schema = "event_id long, ts timestamp, asset string, value double"
    stream = jobs.quality_filter(in_parts(spark, tmp_path / "in", rows, schema, 3, (0, 1, 2)))
    got = {r["event_id"] for r in jobs.drained(stream, str(tmp_path / "out"), str(tmp_path / "check")).collect()}
    last, want = None, set()
    for i, _, _, v in rows:
        if v > 0 and (last is None or 0.2 <= v / last <= 5):
            last = v
            want.add(i)
    assert got == want and math.isfinite(last)


def test_outcomes_of_forecasts_meet_by_asset_and_stretch_of_time(spark, tmp_path):
    """Ticks at a forecast's own time and after its hour are none of its outcomes, the one at the hour's end is; so across midnight, for equal rows and, in batch, before 1970."""
    rng, schema = np.random.default_rng(9), "event_id long, asset string, ts timestamp, value double"
    starts = [pd.Timestamp("1969-12-31 22:00"), pd.Timestamp("2024-01-01 21:30")]
    at = [t + pd.Timedelta(minutes=int(m)) for t in starts for m in np.sort(rng.integers(0, 300, 120))]
    rows = [(i, "AB"[i % 3 == 0], t.to_pydatetime(), float(i)) for i, t in enumerate(at)]
    rows += [(len(rows) + i, *r[1:]) for i, r in enumerate(rows[100:110])]
    hour = pd.Timedelta(hours=1)
    want = sorted((a, t, v, u, w) for i, a, t, v in rows if i % 5 == 0 for _, b, u, w in rows if a == b and t < u <= t + hour)
    assert any(u == t + hour for _, t, _, u, _ in want)

    def joined(ticks, span):
        return jobs.outcomes(ticks.where("event_id % 5 = 0").select("asset", F.col("ts").alias("made_at"), F.col("value").alias("predicted")), ticks, span)

    batch = spark.createDataFrame(rows, schema)
    assert sorted(map(tuple, joined(batch, "INTERVAL 60 MINUTES").collect())) == want
    stream = joined(in_parts(spark, tmp_path / "in", [r for r in rows if r[2].year > 2000], schema, 1, (0,)), "INTERVAL 1 HOUR")
    got = jobs.drained(stream, str(tmp_path / "out"), str(tmp_path / "check")).collect()
    assert sorted(map(tuple, got)) == [r for r in want if r[1].year > 2000]
    assert not joined(batch, "INTERVAL 0 SECONDS").count()
    joins = re.findall(r"(?:SortMergeJoin|ShuffledHashJoin|BroadcastHashJoin) \[(.*?)\]", plan(joined(batch, "INTERVAL 1 HOUR")))
    assert [keys.count("#") for keys in joins] == [2]
