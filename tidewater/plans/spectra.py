"""Market modes, chords and path forecasts (H17 to H27 of the inventory). What they rest on, eigenvectors and peaks, SQL can't express."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions.series import own
from tidewater.operators import align, chords as chord_ops, modes as mode_ops, paths, spectral
from tidewater.sources import tables as t

from .registry import query, rounded


def returns(spark, sf_dir):
    """Log returns of all assets on the weeks that they share, forward filled, as whole series of equal length."""
    grid = align.align_by_coverage(t.bars(spark, sf_dir, "week"), least=60)
    rows = grid.withColumn("r", F.ln(F.col("filled") / F.lag("filled").over(own()))).where("r IS NOT NULL")
    return mode_ops.whole_series(rows, "r")


def modes(spark, sf_dir, count, surrogates=0):
    """Segments of 64 weeks that overlap by four fifths, so that there are more averages than twice the assets."""
    return mode_ops.market_modes(returns(spark, sf_dir), count, surrogates, segment=64, overlap=0.8)


@query("h24_market_modes")
def market_modes(spark, sf_dir):
    return rounded(mode_ops.mode_members(modes(spark, sf_dir, 2)))


@query("h25_mode_significance")
def mode_significance(spark, sf_dir):
    return rounded(mode_ops.mode_significance(modes(spark, sf_dir, 2, 60)))


@query("h26_mode_leaders")
def mode_leaders(spark, sf_dir):
    return rounded(mode_ops.mode_leaders(modes(spark, sf_dir, 5)))


def chords(spark, sf_dir):
    """Of epochs of 512 days, one every 128, so that a class is met in several; peaks count from a fifth above their ring, as in h13."""
    series = spectral.detrended(t.bars(spark, sf_dir))
    return chord_ops.chords(spectral.frequency_patterns(series, spectral.fourier(series, range(5, 52), 64), 64, least_prominence=1.2, least_stability=0.0))


@query("h17_chords")
def chord_rows(spark, sf_dir):
    return rounded(chords(spark, sf_dir).select("asset", "epoch", *[F.transform(c, lambda v: F.round(v, 6)).alias(c) for c in ("periods", "amplitudes", "phases")], "prominence", "stability"))


@query("h18_chord_catalogue")
def chord_catalogue(spark, sf_dir):
    return rounded(chord_ops.catalogue(chord_ops.classified(chords(spark, sf_dir))))


@query("h19_class_pairs")
def class_pairs(spark, sf_dir):
    return rounded(chord_ops.class_pairs(chord_ops.classified(chords(spark, sf_dir)), 2))


@query("h20_chord_shapes")
def chord_shapes(spark, sf_dir):
    rows = chords(spark, sf_dir)
    ahead = [chord_ops.continuation(F.col("periods"), F.col("strengths"), F.col("phases"), F.lit(h)).alias(f"ahead_{h}") for h in (5, 20)]
    return rounded(rows.select("asset", "epoch", chord_ops.harmonic(F.col("periods")).alias("harmonic"), *ahead, chord_ops.sketch(F.col("periods"), F.col("amplitudes")).alias("sketch")))


@query("h21_base_forecast")
def base_forecast(spark, sf_dir):
    return rounded(chord_ops.base_forecast(t.bars(spark, sf_dir), (5, 20, 40)))


@query("h22_spectral_combination")
def spectral_combination(spark, sf_dir):
    return rounded(paths.combined_forecast(t.bars(spark, sf_dir)))


@query("h23_grid_search")
def grid_search(spark, sf_dir):
    return rounded(paths.best_configurations(paths.trials(t.bars(spark, sf_dir), (24, 60, 120), (2, 4), (0.6, 0.75, 0.9))))


@query("h27_math_forecast")
def math_forecast(spark, sf_dir):
    return rounded(paths.math_forecast(t.bars(spark, sf_dir), (5, 20, 40, 90)))
