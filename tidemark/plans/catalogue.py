"""The operators that recipes can name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import falls, frames, islands, measures, profile, spectral, symbols
from tidemark.plans.recipes import Operator, Param, register


def _windows(df: DataFrame, length: int, step: int) -> DataFrame:
    return measures.per_window(frames.windowed(df, length, step), ["recording_id", "start_idx"], measures.FAST)


def _entropy(df: DataFrame, measure: str) -> DataFrame:
    return measures.per_window(df, ["recording_id"], {measure: {**measures.FAST, **measures.SLOW}[measure]})


def _segments(df: DataFrame, points: DataFrame) -> DataFrame:
    return islands.between(points, frames.lengths(df), "idx")


def _trend_words(df: DataFrame, per_segment: int, same_fraction: float) -> DataFrame:
    return symbols.trend_symbols(symbols.trends(frames.z_normalise(df), per_segment), same_fraction)


def _levels(df: DataFrame, per_segment: int, alphabet: int) -> DataFrame:
    p = symbols.paa(frames.z_normalise(df), per_segment)
    return p.select("recording_id", "seg", symbols.quantise(F.col("mean"), symbols.cutlines(alphabet)).alias("symbol"))


def _image(df: DataFrame, kind: str) -> DataFrame:
    """An n x n image as (i, j, v); at most 5,000 samples."""
    m = df.groupBy("recording_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    phi = df.join(m, "recording_id").select("recording_id", "idx", F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), 2 * (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) - 1))).alias("p"))
    other = phi.select("recording_id", F.col("idx").alias("j"), F.col("p").alias("q"))
    v = F.cos(F.col("p") + F.col("q")) if kind == "sum" else F.sin(F.col("p") - F.col("q"))
    return phi.join(other, "recording_id").select("recording_id", F.col("idx").alias("i"), "j", v.alias("v"))


N = Param
for op in (
    Operator("lowpass", "preprocessing", lambda df, cut, fs: spectral.filtered(df, fs, high=cut), params={"cut": N(0.1, float, 0), "fs": N(1.0, float, 0)}),
    Operator("highpass", "preprocessing", lambda df, cut, fs: spectral.filtered(df, fs, low=cut), params={"cut": N(0.01, float, 0), "fs": N(1.0, float, 0)}),
    Operator("bandpass", "preprocessing", lambda df, low, high, fs: spectral.filtered(df, fs, low, high), params={"low": N(0.01, float, 0), "high": N(0.1, float, 0), "fs": N(1.0, float, 0)}),
    Operator("detrend", "preprocessing", frames.detrend, params={"mode": N("rolling_mean", str, choices=("rolling_mean", "rolling_z", "linear")), "window": N(600, int, 3)}),
    Operator("window_matrix", "preprocessing", _windows, output_kind="windowset", params={"length": N(64, int, 32), "step": N(32, int, 1)}),
    Operator("entropy", "detection", _entropy, output_kind="scores", params={"measure": N("spectral_entropy", str, choices=(*measures.FAST, *measures.SLOW))}),
    Operator("spectrum", "detection", lambda df, window, hop: spectral.marks(df, lambda x: [(k, float(v)) for k, v in enumerate(measures.stft_log_spectrum(x, window, hop))] if len(x) >= window else [], "band long, power double"), output_kind="encoding", params={"window": N(32, int, 4), "hop": N(16, int, 1)}),
    Operator("matrix_profile", "detection", lambda df, m: profile.matrix_profile(df, m), output_kind="scores", params={"m": N(8, int, 3)}),
    Operator("change_points", "detection", lambda df, penalty, min_size, jump, algorithm: _segments(df, spectral.change_points(df, penalty, min_size, jump, algorithm)), output_kind="spanset", params={"penalty": N(10.0, float, 0), "min_size": N(2, int, 1), "jump": N(5, int, 1), "algorithm": N("exact", str, choices=("exact", *spectral.ALGORITHMS))}),
    Operator("level_symbols", "detection", _levels, output_kind="encoding", params={"per_segment": N(6, int, 2), "alphabet": N(5, int, 2, 26)}),
    Operator("trend_symbols", "detection", _trend_words, output_kind="encoding", params={"per_segment": N(6, int, 2), "same_fraction": N(0.5, float, 0, 1)}),
    Operator("spikes", "detection", lambda df, width, delta, distance: _segments(df, islands.refractory(frames.spike_candidates(df, width, delta), ["recording_id"], "idx", distance)), output_kind="spanset", params={"width": N(20, int, 1), "delta": N(0.01), "distance": N(30, int, 1)}),
    Operator("drops", "detection", lambda df, fs, detrend_s, segment_s, slope_sigma: falls.drops(df, fs, detrend_s=detrend_s, segment_s=segment_s, slope_sigma=slope_sigma), output_kind="spanset", params={"fs": N(1.0, float, 0), "detrend_s": N(600.0, float, 0), "segment_s": N(20.0, float, 0), "slope_sigma": N(8.0, float, 0)}),
    Operator("wavelet_energy", "detection", lambda df, scales: spectral.per_recording(df, lambda x: spectral.morse_energy(x, scales), "value"), output_kind="scores", params={"scales": N(64, int, 2)}),
    Operator("sum_field", "catalogue", lambda df: _image(df, "sum"), output_kind="encoding", most_samples=5000),
    Operator("difference_field", "catalogue", lambda df: _image(df, "difference"), output_kind="encoding", most_samples=5000),
):
    register(op)
