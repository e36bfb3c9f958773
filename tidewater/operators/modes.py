"""Common oscillations of a market: eigenvectors of coherency matrices, whether they mean anything, and who leads in them.

Each asset's series is one row. Surrogates of it are further rows, so that a thousand of them are a thousand times the rows and
nothing else; tasks transform whole series, Spark groups the Fourier sums by surrogate and range of frequencies, and a group
solves its matrices at once. A group is small by its nature: matrices of more assets than half the averages that they are
estimated from mean nothing and aren't solved.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MEMBERS = "array<struct<asset:string,loading:double,phase:double,lead:double>>"
#: Frequencies that a group solves.
RANGE = 32


def whole_series(rows: DataFrame, value: str) -> DataFrame:
    """asset, x: each asset's values in order of time, one row an asset."""
    gathered = rows.groupBy("asset").agg(F.array_sort(F.collect_list(F.struct("ts", F.col(value).alias("v")))).alias("_s"))
    return gathered.select("asset", F.transform("_s", lambda p: p["v"]).alias("x"))


def surrogate(x: np.ndarray, seed: tuple[int, ...]) -> np.ndarray:
    """A series with the same power at every frequency and random phases. The length must be a power of two."""
    f = np.fft.rfft(x)
    f[1:-1] *= np.exp(2j * np.pi * np.random.default_rng(seed).random(len(f) - 2))
    return np.fft.irfft(f, len(x))


def smoothing(k: int, least: int) -> int:
    """Neighbours on either side that a frequency is averaged with: in proportion to it, so that bands are equally wide in periods."""
    return max(least, round(k * 0.08))


def market_modes(
    series: DataFrame, modes: int = 1, surrogates: int = 0, segment: int = 256, overlap: float = 0.5, shortest: float = 5.0, longest: float = 250.0, smooth: int = 3, seed: int = 20260821,
) -> DataFrame:
    """run, k, mode, period, share, spread, members (asset, loading, phase in degrees, lead in bars) of the leading eigenvectors at each
    frequency: mode 2 is what leads when mode 1 has been taken out, and so on.

    series: asset, x of equal length, of which the last power of two is used. run 0 is the series themselves, 1, 2, ... are surrogates, whose phases
    are random and whose members are left out. Phases are those against the mean of the members' pointers, so that a positive lead
    runs ahead of the mode as a whole. Too few assets (4), segments (3) or averages (twice the assets) give no rows, as does unequal length.
    """
    shape = series.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most"), F.count(F.lit(1)).alias("n")).first()
    schema = f"run int, k int, mode int, period double, share double, spread double, members {MEMBERS}"
    length = 1 << max(0, int(shape["least"] or 0).bit_length() - 1)
    segment = min(segment, length // 3)
    starts = list(range(0, length - segment + 1, max(1, int(segment * (1 - overlap))))) if segment >= 32 else []
    padded = 1 << max(1, (2 * segment - 1).bit_length())
    bins = [k for k in range(1, padded // 2) if shortest <= padded / k <= longest]
    if shape["n"] < 4 or shape["least"] != shape["most"] or len(starts) < 3 or len(starts) * (2 * smooth + 1) < 2 * shape["n"] or not bins:
        return series.sparkSession.createDataFrame([], schema)
    top = padded // 2 - 1
    reach = {k: (max(1, k - smoothing(k, smooth)), min(top, k + smoothing(k, smooth))) for k in bins}
    ranges = [bins[a : a + RANGE] for a in range(0, len(bins), RANGE)]
    needs = [(min(reach[k][0] for k in r), max(reach[k][1] for k in r)) for r in ranges]
    wanted = np.arange(min(a for a, _ in needs), max(b for _, b in needs) + 1)
    at, hann = np.add.outer(starts, np.arange(segment)), 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(segment) / (segment - 1))

    def transform(batches):
        for batch in batches:
            out = {"run": [], "asset": [], "range": [], "re": [], "im": []}
            for run, asset, x in zip(batch["run"], batch["asset"], batch["x"], strict=True):
                x = np.asarray(x, float)[-length:]
                x = surrogate(x, (seed, int(run), zlib.crc32(asset.encode()))) if run else x
                parts = x[at]
                f = np.fft.rfft((parts - parts.mean(axis=1, keepdims=True)) * hann, padded, axis=1)[:, wanted]
                for number, (a, b) in enumerate(needs):
                    own = f[:, a - wanted[0] : b + 1 - wanted[0]].ravel()
                    for name, value in zip(out, (run, asset, number, own.real, own.imag), strict=True):
                        out[name].append(value)
            yield pd.DataFrame(out)

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("asset")
        names, run, number = part["asset"].tolist(), int(part["run"].iloc[0]), int(part["range"].iloc[0])
        first, n = needs[number][0], len(names)
        z = (np.stack(part["re"].to_numpy()) + 1j * np.stack(part["im"].to_numpy())).reshape(n, len(starts), -1).transpose(2, 0, 1)
        crossed = np.concatenate([np.zeros((1, n, n), complex), np.cumsum(z @ z.conj().transpose(0, 2, 1), axis=0)])
        low, high = (np.array([reach[k][side] - first + side for k in ranges[number]]) for side in (0, 1))
        s = crossed[high] - crossed[low]
        power = np.sqrt(np.maximum(1e-300, np.einsum("kii->ki", s).real))
        values, vectors = np.linalg.eigh(s / power[:, :, None] / power[:, None, :])
        rows = []
        for j, k in enumerate(ranges[number]):
            for mode in range(1, min(modes, n) + 1):
                v, period = vectors[j, :, -mode], padded / k
                turned = np.angle(v * np.exp(-1j * np.angle(v.sum())))
                loading, lead = np.abs(v), turned / (2 * np.pi) * period
                mean = (loading * lead).sum() / loading.sum()
                spread = float(np.sqrt((loading * (lead - mean) ** 2).sum() / loading.sum()))
                members = [] if run else [{"asset": a, "loading": x, "phase": y, "lead": t} for a, x, y, t in zip(names, loading, np.degrees(turned), lead, strict=True)]
                rows.append((run, k, mode, period, float(min(1, max(0, values[j, -mode] / n))), spread, members))
        return pd.DataFrame(rows, columns=["run", "k", "mode", "period", "share", "spread", "members"])

    each = series.select("asset", "x", F.explode(F.sequence(F.lit(0), F.lit(surrogates))).alias("run")).repartition("run", "asset")
    moved = each.mapInPandas(transform, "run int, asset string, range int, re array<double>, im array<double>")
    return moved.groupBy("run", "range").applyInPandas(solve, schema)


def mode_members(found: DataFrame, top: int = 15) -> DataFrame:
    """k, mode, period, share, spread and one row for each of the ``top`` strongest members of the modes of the series themselves."""
    rows = found.where("run = 0").select("k", "mode", "period", "share", "spread", F.explode("members").alias("_m"))
    rows = rows.select("k", "mode", "period", "share", "spread", "_m.*")
    order = Window.partitionBy("k", "mode").orderBy(F.desc("loading"), "asset")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def mode_significance(found: DataFrame, level: float = 0.95) -> DataFrame:
    """k, mode, period, share, surrogate_share, surrogate_sd, z, threshold, significant of modes with surrogates.

    The threshold is the quantile of the surrogates' maxima over all frequencies and modes: as many are tested at once, some stand out
    by chance in every run, and the question is whether the one that stands out most does so more than chance's own."""
    draws = found.where("run > 0").select("run", "k", "mode", "share")
    level_of = draws.groupBy("k", "mode").agg(F.avg("share").alias("surrogate_share"), F.coalesce(F.stddev_samp("share"), F.lit(0.0)).alias("surrogate_sd"))
    real = found.where("run = 0").select("k", "mode", "period", "share").join(level_of, ["k", "mode"])
    z = F.when(F.col("surrogate_sd") > 1e-12, (F.col("share") - F.col("surrogate_share")) / F.col("surrogate_sd"))
    maxima = draws.join(level_of, ["k", "mode"]).groupBy("run").agg(F.coalesce(F.max(z), F.lit(0.0)).alias("_z"))
    sorted_ = maxima.agg(F.array_sort(F.collect_list("_z")).alias("_all"))  # one number a surrogate run
    limit = sorted_.select(F.get("_all", (F.ceil(F.lit(level) * F.size("_all")) - 1).cast("int")).alias("threshold"))
    rows = real.crossJoin(limit).withColumn("z", F.coalesce(z, F.lit(0.0)))
    return rows.withColumn("significant", F.col("z") > F.col("threshold"))


BANDS = (("short", 5.0, 15.0), ("middle", 15.0, 60.0), ("long", 60.0, 250.0))


def mode_leaders(found: DataFrame, skip: int = 1, least: int = 3, bands: tuple[tuple[str, float, float], ...] = BANDS) -> DataFrame:
    """band, asset, modes, weight, lead_share, lead_bars, spread, steadiness: by how much of a period each asset leads the modes of a band.

    Weights are loading times explained share; the first ``skip`` modes, in which all moves at once, tell nothing about who leads. lead_bars is the
    share at the band's middle, steadiness the lead over its own spread."""
    band = F.array(*[F.struct(F.lit(n).alias("band"), F.lit(a).alias("low"), F.lit(b).alias("high")) for n, a, b in bands])
    rows = found.where((F.col("run") == 0) & (F.col("mode") > skip)).select("period", "share", F.explode("members").alias("_m"))
    rows = rows.select("period", "share", "_m.*").withColumn("_b", F.explode(band)).where("period >= _b.low AND period < _b.high")
    w, rel = F.col("loading") * F.col("share"), F.col("lead") / F.col("period")
    sums = rows.groupBy("_b", "asset").agg(F.count(F.lit(1)).alias("modes"), F.sum(w).alias("weight"), F.sum(w * rel).alias("_s"), F.sum(w * rel * rel).alias("_q")).where((F.col("weight") > 0) & (F.col("modes") >= least))
    mean = F.col("_s") / F.col("weight")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("_q") / F.col("weight") - mean * mean))
    out = sums.select("_b.band", "asset", "modes", "weight", mean.alias("lead_share"), (mean * (F.col("_b.low") + F.col("_b.high")) / 2).alias("lead_bars"), spread.alias("spread"))
    return out.withColumn("steadiness", F.when(F.col("spread") > 1e-9, F.abs("lead_share") / F.col("spread")).otherwise(0.0))
