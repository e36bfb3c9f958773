"""Market modes, chords, path forecasts and leaders learned on the way: planted signals, brute force, nothing read ahead."""

import math
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.operators import chords, forecast, leading, modes, paths


def frame(spark, x, names=None):
    rows = [(names[a] if names else f"A{a:02d}", [float(v) for v in one]) for a, one in enumerate(x)]
    return spark.createDataFrame(rows, "asset string, x array<double>")


def bars_of(spark, closes, start="2015-01-01"):
    days = pd.date_range(start, periods=max(map(len, closes.values())))
    rows = [(a, days[i].to_pydatetime(), float(c)) for a, one in closes.items() for i, c in enumerate(one) if c is not None]
    return spark.createDataFrame(rows, "asset string, ts timestamp, close double")


# modes -----------------------------------------------------------------------------------------------------------------


def reference_modes(x, count, segment, overlap, shortest, longest, smooth):
    """One frequency at a time, leading vectors by power iteration and deflation."""
    n, length = len(x), 1 << (len(x[0]).bit_length() - 1)
    x = np.array(x)[:, -length:]
    padded, hann = 1 << (2 * segment - 1).bit_length(), 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(segment) / (segment - 1))
    parts = [x[:, s : s + segment] for s in range(0, length - segment + 1, max(1, int(segment * (1 - overlap))))]
    spectra = [np.fft.fft((p - p.mean(axis=1, keepdims=True)) * hann, padded) for p in parts]
    out = {}
    for k in range(1, padded // 2):
        if shortest <= padded / k <= longest:
            wide = max(smooth, round(k * 0.08))
            s = sum(np.outer(f[:, b], f[:, b].conj()) for f in spectra for b in range(max(1, k - wide), min(padded // 2 - 1, k + wide) + 1))
            d = np.sqrt(np.diag(s).real)
            s = s / np.outer(d, d)
            for mode in range(1, count + 1):
                v = np.random.default_rng(k).normal(size=n) + 0j
                for _ in range(3000):
                    v = s @ v
                    v /= np.linalg.norm(v)
                value = (v.conj() @ s @ v).real
                out[k, mode] = value / n, np.abs(v), np.angle(v * np.exp(-1j * np.angle(v.sum()))) / (2 * np.pi) * padded / k
                s = s - value * np.outer(v, v.conj())
    return out


def planted(n=8, length=1024, lag=2, second=True, seed=4):
    """All assets swing together with a period of 40, each ``lag`` bars behind the one before; half against half with one of 12."""
    rng = np.random.default_rng(seed)
    t = np.arange(length)
    slow, fast = rng.uniform(0, 6), rng.uniform(0, 6)
    return [np.sin(2 * np.pi * (t - lag * a) / 40 + slow) + (np.sin(2 * np.pi * t / 12 + fast) * (1 if a % 2 else -1) if second else 0) + rng.normal(size=length) for a in range(n)]


def test_modes_equal_deflated_power_iteration(spark):
    x = planted()
    want = reference_modes(x, 2, 128, 0.5, 5, 100, 3)
    found = {(r["k"], r["mode"]): r for r in modes.market_modes(frame(spark, x), 2, segment=128, longest=100.0).collect()}
    assert found.keys() == want.keys()
    for key, (share, loading, lead) in want.items():
        assert found[key]["share"] == pytest.approx(share, abs=1e-6)
        if key[1] == 1:
            assert [m["loading"] for m in found[key]["members"]] == pytest.approx(loading.tolist(), abs=1e-4)
            assert [m["lead"] for m in found[key]["members"]] == pytest.approx(lead.tolist(), abs=0.05)


def test_planted_modes_and_their_leads(spark):
    rows = modes.market_modes(frame(spark, planted()), 2, segment=256).where("mode = 1").collect()
    near = min(rows, key=lambda r: abs(r["period"] - 40))
    leads = [m["lead"] for m in sorted(near["members"], key=lambda m: m["asset"])]
    assert near["share"] > 0.5 and np.polyfit(range(8), leads, 1)[0] == pytest.approx(-2.0, abs=0.2)
    fast = min(rows, key=lambda r: abs(r["period"] - 12))
    turned = [m["phase"] for m in sorted(fast["members"], key=lambda m: m["asset"])]
    apart = abs((turned[0] - turned[1] + 180) % 360 - 180)
    assert fast["share"] > 0.4 and apart > 150 and near["spread"] > 3


def test_two_modes_at_one_frequency_are_told_apart(spark):
    rng, t = np.random.default_rng(8), np.arange(1024)
    one, two = rng.normal(size=1024), rng.normal(size=1024)
    swing = lambda noise: np.convolve(noise, np.cos(2 * np.pi * np.arange(60) / 20) * np.exp(-np.arange(60) / 30))[: len(t)]
    x = [(swing(one) if a < 5 else swing(two)) * (1 if a < 5 else 0.8) + 0.5 * rng.normal(size=1024) for a in range(8)]
    rows = modes.market_modes(frame(spark, x), 2, segment=128).collect()
    near = min((r["k"] for r in rows), key=lambda k: abs(256 / k - 20))
    groups = []
    for mode in (1, 2):
        members = next(r for r in rows if (r["k"], r["mode"]) == (near, mode))["members"]
        strong = sorted(members, key=lambda m: -m["loading"])
        groups.append({m["asset"] for m in strong[: 5 if mode == 1 else 3]})
    assert groups == [{f"A{a:02d}" for a in range(5)}, {f"A{a:02d}" for a in range(5, 8)}]


def test_surrogates_keep_the_power_and_lose_the_common_phase():
    x = np.array(planted(2))
    a, b = modes.surrogate(x[0], (1, 1, 7)), modes.surrogate(x[0], (1, 2, 7))
    assert np.abs(np.fft.rfft(a)) == pytest.approx(np.abs(np.fft.rfft(x[0]))) and a.mean() == pytest.approx(x[0].mean())
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.3 and (modes.surrogate(x[0], (1, 1, 7)) == a).all()


def test_significance_finds_the_planted_and_passes_little_noise(spark):
    signal = modes.mode_significance(modes.market_modes(frame(spark, planted()), 1, 40, segment=256)).collect()
    assert min(signal, key=lambda r: abs(r["period"] - 40))["significant"]
    runs = 0
    for seed in range(12):
        noise = np.random.default_rng(100 + seed).normal(size=(6, 512))
        rows = modes.mode_significance(modes.market_modes(frame(spark, noise), 1, 20, segment=64, smooth=2)).collect()
        assert all(r["z"] == pytest.approx((r["share"] - r["surrogate_share"]) / r["surrogate_sd"]) for r in rows)
        runs += any(r["significant"] for r in rows)
    assert runs <= 4


def test_modes_of_too_little(spark):
    assert modes.market_modes(frame(spark, planted(3)), 1).count() == 0
    assert modes.market_modes(frame(spark, planted(8, 64)), 1).count() == 0
    assert modes.market_modes(frame(spark, planted(40, 256)), 1, segment=64).count() == 0
    assert modes.market_modes(frame(spark, [p[: 512 - a] for a, p in enumerate(planted(5))]), 1).count() == 0
    assert modes.market_modes(frame(spark, planted(4)).limit(0), 1).count() == 0


def test_mode_leaders_are_weighted_moments(spark):
    found = modes.market_modes(frame(spark, planted()), 4, segment=256)
    want = defaultdict(list)
    for r in found.collect():
        for band, low, high in modes.BANDS:
            if r["mode"] > 1 and low <= r["period"] < high:
                for m in r["members"]:
                    want[band, m["asset"]].append((m["loading"] * r["share"], m["lead"] / r["period"], (low + high) / 2))
    rows = modes.mode_leaders(found).collect()
    assert {(r["band"], r["asset"]) for r in rows} == {k for k, v in want.items() if len(v) >= 3}
    for r in rows:
        w, rel, middle = map(np.array, zip(*want[r["band"], r["asset"]], strict=True))
        mean = (w * rel).sum() / w.sum()
        assert r["lead_share"] == pytest.approx(mean, abs=1e-9) and r["lead_bars"] == pytest.approx(mean * middle[0], abs=1e-7)
        assert r["spread"] == pytest.approx(math.sqrt(max(0, (w * rel**2).sum() / w.sum() - mean**2)), abs=1e-6)


# chords ----------------------------------------------------------------------------------------------------------------

PATTERN = "asset string, epoch long, period double, prominence double, stability double, phase double, amplitude double"


def test_chords_keep_the_strongest_longest_first(spark):
    rows = [("A", 0, 20.0, 10.0, 0.8, 10.0, 4.0), ("A", 0, 60.0, 7.0, 0.6, 20.0, 2.0), ("A", 0, 30.0, 5.9, 1.0, 30.0, 9.0), ("A", 0, 15.0, 6.0, 0.7, 40.0, 1.0), ("A", 0, 8.0, 6.5, 0.5, 50.0, 3.0), ("B", 1, 40.0, 2.0, 0.9, 5.0, 0.0)]
    got = {r["asset"]: r for r in chords.chords(spark.createDataFrame(rows, PATTERN)).collect()}
    a = got["A"]
    assert a["periods"] == [60.0, 20.0, 8.0] and a["phases"] == [20.0, 10.0, 50.0] and a["amplitudes"] == [1.0, 2.0, 1.5] and a["strengths"] == [2.0, 4.0, 3.0]
    assert a["prominence"] == pytest.approx(23.5 / 3) and a["stability"] == pytest.approx(1.9 / 3)
    assert got["B"]["periods"] == [40.0] and got["B"]["amplitudes"] == [1.0]


CHORD = "asset string, epoch long, periods array<double>, amplitudes array<double>, strengths array<double>, phases array<double>, prominence double, stability double"


def many_chords(n=200, seed=2):
    rng, out = np.random.default_rng(seed), []
    for i in range(n):
        voices = int(rng.integers(1, 4))
        periods = sorted((float(b * math.exp(0.1 * rng.normal())) for b in rng.choice([12, 20, 33, 55, 90], voices, replace=False)), reverse=True)
        out.append((f"A{i % 9}", i // 9, periods, [1.0] * voices, [0.5] * voices, [float(p) for p in rng.uniform(0, 360, voices)], float(rng.integers(20, 60)) / 7, 0.5))
    return out


def test_catalogue_equals_a_sequential_walk(spark):
    rows = many_chords()
    want = {}
    shards = defaultdict(list)
    for r in rows:
        shards[len(r[2]), math.floor(math.log2(r[2][0]))].append(r)
    for (voices, octave), part in shards.items():
        classes = []
        for r in sorted(part, key=lambda r: (-r[6], r[0], r[1])):
            number = next((k for k, members in enumerate(classes) if all(abs(p - c) / c <= 0.12 for p, c in zip(r[2], [np.median([m[2][v] for m in members]) for v in range(voices)], strict=True))), len(classes))
            if number == len(classes):
                classes.append([])
            classes[number].append(r)
            want[r[0], r[1]] = voices, octave, number
    shuffled = spark.createDataFrame(rows[::-1], CHORD).repartition(5)
    members = chords.classified(shuffled)
    assert {(r["asset"], r["epoch"]): (r["voices"], r["octave"], r["class"]) for r in members.collect()} == want
    sizes = defaultdict(list)
    for r in rows:
        sizes[want[r[0], r[1]]].append(r)
    found = {(r["voices"], r["octave"], r["class"]): r for r in chords.catalogue(members).collect()}
    assert found.keys() == {k for k, v in sizes.items() if len(v) >= 3}
    for key, r in found.items():
        assert r["periods"] == pytest.approx([np.median([m[2][v] for m in sizes[key]]) for v in range(key[0])])
        assert r["chords"] == len(sizes[key]) and r["assets"] == len({m[0] for m in sizes[key]})


def test_class_pairs_are_steady_or_not(spark):
    rng, rows = np.random.default_rng(3), []
    for epoch in range(6):
        at = float(rng.uniform(0, 360))
        for name, turn in (("A", 0.0), ("B", 45.0 + epoch * 0.2), ("C", float(rng.uniform(0, 360)))):
            rows.append((name, epoch, [40.0], [1.0], [1.0], [(at + turn) % 360], 5.0, 0.9))
    found = {(r["a"], r["b"]): r for r in chords.class_pairs(chords.classified(spark.createDataFrame(rows, CHORD))).collect()}
    assert found["A", "B"]["steady"] and found["A", "B"]["mean_lag"] == pytest.approx(45.5 / 360 * 40, abs=0.01) and found["A", "B"]["epochs"] == 6
    assert not found["A", "C"]["steady"]


def test_names_sketches_and_continuations(spark):
    rows = [("a", [40.0]), ("b", [40.0, 20.1]), ("c", [40.0, 29.0]), ("d", [60.0, 40.0, 11.0]), ("e", [60.0, 30.0, 20.0])]
    df = spark.createDataFrame(rows, "asset string, periods array<double>")
    assert {r[0]: r[1] for r in df.select("asset", chords.harmonic(F.col("periods"))).collect()} == {"a": "pure", "b": "overtone", "c": "beat", "d": "triad", "e": "overtone"}
    one = spark.createDataFrame([([40.0, 15.0], [1.0, 0.5], [30.0, 200.0])], "p array<double>, a array<double>, f array<double>")
    curve, ahead = one.select(chords.sketch(F.col("p"), F.col("a")), chords.continuation(F.col("p"), F.col("a"), F.col("f"), F.lit(7))).first()
    t = np.linspace(0, 80, 96)
    y = np.cos(2 * np.pi * t / 40) + 0.5 * np.cos(2 * np.pi * t / 15)
    assert curve == pytest.approx((y / np.abs(y).max()).tolist(), abs=6e-4)
    want = sum(a * (math.cos(2 * math.pi * 7 / p + math.radians(f)) - math.cos(math.radians(f))) for p, a, f in ((40, 1, 30), (15, 0.5, 200)))
    assert ahead == pytest.approx(want)


def test_base_forecast_of_a_planted_chord_and_of_noise(spark):
    rng, t = np.random.default_rng(5), np.arange(1064)
    wave = np.exp(4 + 0.1 * np.sin(2 * np.pi * t / 32) + 0.002 * rng.normal(size=len(t)))
    noise = np.exp(4 + 0.01 * rng.normal(size=len(t)))
    got = {(r["asset"], r["h"]): r for r in chords.base_forecast(bars_of(spark, {"wave": wave, "noise": noise, "short": wave[:1063]}), (8, 40, 41), least_prominence=4.0, least_stability=0.5).collect()}
    assert {a for a, _ in got} == {"wave", "noise"}
    truth = 0.1 * (math.sin(2 * math.pi * 1071 / 32) - math.sin(2 * math.pi * 1063 / 32))
    assert got["wave", 8]["skill"] > 0.6 and got["wave", 8]["value"] == pytest.approx(truth, abs=0.03)
    assert got["wave", 41]["value"] is None and got["noise", 8]["skill"] == 0 and got["noise", 8]["value"] is None


# paths -----------------------------------------------------------------------------------------------------------------


def test_math_forecast_of_a_wave_and_of_noise(spark):
    rng, t = np.random.default_rng(1), np.arange(420)
    wave = np.exp(3 + 0.05 * np.sin(2 * np.pi * t / 30) + 0.001 * rng.normal(size=len(t)))
    flat = np.exp(3 + 0.01 * rng.normal(size=len(t)))
    closes = {"wave": wave, "dead": [*wave[:-1], 0.0], "short": wave[:119], "flat": flat}
    got = {(r["asset"], r["h"]): r for r in paths.math_forecast(bars_of(spark, closes), (10, 40, 41)).collect()}
    assert {a for a, _ in got} == {"wave", "flat"}
    truth = 0.05 * (math.sin(2 * math.pi * 429 / 30) - math.sin(2 * math.pi * 419 / 30))
    assert got["wave", 10]["skill"] > 0.8 and got["wave", 10]["value"] == pytest.approx(truth, abs=0.01)
    assert got["wave", 41]["value"] is None
    assert all(r["value"] is None for r in got.values() if r["skill"] == 0)


def test_combination_follows_the_skilled(spark):
    rng, t = np.random.default_rng(2), np.arange(700)
    wave = np.exp(3 + 0.05 * np.sin(2 * np.pi * t / 25) + 0.001 * rng.normal(size=len(t)))
    walk = np.exp(3 + np.cumsum(0.02 * np.where(np.arange(700) % 2, 1, -1) * rng.uniform(0.5, 1.5, 700)))
    got = pd.DataFrame([r.asDict() for r in paths.combined_forecast(bars_of(spark, {"wave": wave, "walk": walk, "short": wave[:100]}), 20).collect()])
    own = got[got["asset"] == "wave"].sort_values("step")
    truth = 0.05 * (np.sin(2 * np.pi * (699 + own["step"]) / 25) - np.sin(2 * np.pi * 699 / 25))
    assert len(own) == 20 and np.abs(own["value"] - truth).sum() < 0.5 * np.abs(truth).sum()
    assert np.allclose(own["ssa_weight"] + own["cycle_weight"], 1) and np.allclose(own["value"], own["ssa_weight"] * own["ssa"] + own["cycle_weight"] * own["cycle"])
    assert "short" not in set(got["asset"])


def test_grid_search_equals_a_loop(spark):
    rng, t = np.random.default_rng(3), np.arange(900)
    closes = {a: np.exp(3 + 0.05 * np.sin(2 * np.pi * t / p) + np.cumsum(0.003 * rng.normal(size=len(t)))) for a, p in (("A", 20), ("B", 45), ("C", 70))}
    closes["D"] = closes["A"][:430]
    found = {(r["window"], r["components"]): r for r in paths.best_configurations(paths.trials(bars_of(spark, closes), (30, 0), (2, 6), (0.4, 0.5, 0.99), 20)).collect()}
    for window in (30, 0):
        for count in (2, 6):
            skills = []
            for x in closes.values():
                for share in (0.4, 0.5, 0.99):
                    cut = int(len(x) * share)
                    if cut >= 400 and cut + 20 < len(x):
                        past, truth = np.log(x[:cut]), np.log(x[cut : cut + 20])
                        path, _ = paths.ssa_forecast(past, window or cut // 4, count, 20)
                        skills.append(1 - np.abs(path - truth).sum() / np.abs(past[-1] - truth).sum())
            r = found[window, count]
            assert r["evaluations"] == len(skills) == 3 and r["skill"] == pytest.approx(np.mean(skills)) and r["skill_sd"] == pytest.approx(np.std(skills, ddof=1))


# leaders on the way ----------------------------------------------------------------------------------------------------


def market(n=4, days=400, lag=3, seed=7):
    """B follows A after ``lag`` days; every asset misses days of its own."""
    rng = np.random.default_rng(seed)
    moves = 0.02 * rng.normal(size=(n, days))
    moves[1, lag:] = 0.9 * moves[0, :-lag] + 0.3 * moves[1, lag:]
    closes = 100 * np.exp(np.cumsum(moves, axis=1))
    return {"ABCDEFGH"[a]: [None if a and rng.random() < 0.03 else float(c) for c in closes[a]] for a in range(n)}


def brute_statistics(closes, upto, window, most=12):
    out = {}
    names = sorted(closes)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            at = [t for t in range(max(0, upto - window), upto + 1) if closes[a][t] is not None and closes[b][t] is not None]
            if len(at) < 60:
                continue
            x, y = (np.diff(np.log([closes[s][t] for t in at])) for s in (a, b))
            r = lambda u, v: float(np.corrcoef(u, v)[0, 1])
            now, best = r(x, y), (0, r(x, y))
            if abs(round(now, 9)) >= 0.05:
                each = {k: r(x[: len(x) - k], y[k:]) if k >= 0 else r(x[-k:], y[:k]) for k in range(-most, most + 1)}
                lag = max(each, key=lambda k: (round(abs(each[k]), 9), -k))
                best = lag, each[lag]
            out[a, b] = len(at), now, *best
    return out


@pytest.mark.parametrize("tile", [32, 1])
def test_refreshes_equal_brute_force(spark, tile):
    closes = market()
    found = defaultdict(dict)
    for r in leading.pair_refreshes(bars_of(spark, closes), 60, 45, 150, threshold=0.05, tile=tile).collect():
        found[r["refresh"]][r["a"], r["b"]] = r["n"], r["corr0"], r["lag"], r["lag_corr"]
    assert set(found) == set(range(60, 400, 45)) - {60} | ({60} if brute_statistics(closes, 60, 150) else set())
    for upto, pairs in found.items():
        want = brute_statistics(closes, upto, 150)
        assert pairs.keys() == want.keys()
        for key, (n, now, lag, corr) in want.items():
            assert pairs[key][0] == n and pairs[key][2] == lag and pairs[key][1] == pytest.approx(now, abs=1e-9) and pairs[key][3] == pytest.approx(corr, abs=1e-9)


def signals(spark, closes):
    bars = bars_of(spark, closes)
    return leading.lead_signals(leading.pair_refreshes(bars, 60, 45, 150, threshold=0.0), bars)


def test_signals_hold_the_leaders_last_moves(spark):
    closes = market()
    rows = signals(spark, closes).collect()
    led = [r for r in rows if r["asset"] == "B" and r["leader"] == "A"]
    assert len(led) >= 7 and all(r["lag"] == 3 for r in led) and np.mean([r["lag_corr"] for r in led]) > 0.8
    for r in rows:
        own = [c for c in closes[r["leader"]][: r["refresh"] + 1] if c is not None]
        assert r["recent"] == pytest.approx(math.log(own[-1] / own[max(0, len(own) - 1 - r["lag"])]), abs=1e-9)


def five(spark, closes, horizons=(1, 3), number=1):
    bars = bars_of(spark, closes)
    known = leading.lead_predictions(leading.lead_signals(leading.pair_refreshes(bars, 60, 45, 150, threshold=0.0), bars), horizons)
    rows = leading.with_leaders(forecast.forecasts(bars, horizons), known, leading.calendar(bars), 60, 45)
    return rows.withColumn("pass", F.lit(number)).withColumn("hours", 24 * F.col("h"))


def brute_walk(passes):
    """Bar by bar: what has arrived is learned from, then the next forecast is made."""
    out, weights = {}, defaultdict(lambda: np.full(5, 0.2))
    for number, rows in passes:
        for (asset, hours), part in rows.groupby(["asset", "hours"]):
            waiting = []
            for r in part.sort_values("rn").itertuples():
                while waiting and waiting[0][0] <= r.rn:
                    _, p, actual = waiting.pop(0)
                    loss = [min(4, abs(x - actual) / max(0.002, 2 * abs(actual))) + (1.2 if abs(actual) > 1e-5 and (abs(x) < 1e-4 or np.sign(x) != np.sign(actual)) else 0) for x in p]
                    w = weights[asset, hours] * np.exp(-0.5 * np.array(loss))
                    w = np.maximum(0.01, w / w.sum())
                    weights[asset, hours] = w / w.sum()
                p = [getattr(r, m) for m in leading.FIVE]
                out[number, asset, hours, r.rn] = float(np.dot(weights[asset, hours], np.clip(p, -0.5, 0.5)))
                waiting.append((r.rn + r.h, p, math.log(r.actual_close / r.close)))
            for _, p, actual in waiting:
                loss = [min(4, abs(x - actual) / max(0.002, 2 * abs(actual))) + (1.2 if abs(actual) > 1e-5 and (abs(x) < 1e-4 or np.sign(x) != np.sign(actual)) else 0) for x in p]
                w = weights[asset, hours] * np.exp(-0.5 * np.array(loss))
                w = np.maximum(0.01, w / w.sum())
                weights[asset, hours] = w / w.sum()
    return out, weights


def test_three_passes_equal_a_walk_bar_by_bar(spark):
    one, other = five(spark, market(3, 200)), five(spark, market(3, 150, seed=8), number=2)
    made = one.unionByName(other).unionByName(one.withColumn("pass", F.lit(3)))
    tables = {n: part for n, part in made.where("rn > 60 AND actual_close IS NOT NULL").toPandas().groupby("pass")}
    want, weights = brute_walk([(n, tables[n]) for n in (1, 2, 3)])
    walked = leading.walk_passes(made)
    got = {(r["pass"], r["asset"], r["hours"], r["rn"]): r["combined"] for r in walked.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    learned = {(r["asset"], r["hours"], r["model"]): r["weight"] for r in leading.learned(walked).collect()}
    assert learned == {(a, h, m): pytest.approx(w[k]) for (a, h), w in weights.items() for k, m in enumerate(leading.FIVE)}
    assert sum(w for (a, h, _), w in learned.items() if (a, h) == ("B", 24)) == pytest.approx(1)


def test_no_forecast_sees_what_comes_later(spark):
    closes = market(4, 300)
    changed = {a: [c if i < 220 or c is None else c * (1.5 if (i + len(a)) % 2 else 0.6) for i, c in enumerate(one)] for a, one in closes.items()}
    got = []
    for each in (closes, changed):
        rows = leading.walk_passes(five(spark, each)).collect()
        got.append({(r["asset"], r["hours"], r["ts"]): r["combined"] for r in rows if (r["ts"] - pd.Timestamp("2015-01-01")).days < 216})
    assert got[0].keys() == got[1].keys() and len(got[0]) > 600 and got[0] == got[1]


def test_leaders_help_the_led(spark):
    made = five(spark, market(3, 400))
    rows = made.where("asset = 'B' AND h = 1 AND actual_close IS NOT NULL AND rn > 120").toPandas()
    assert (rows["leadlag"] != 0).mean() > 0.8
