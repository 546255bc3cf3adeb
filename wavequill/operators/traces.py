"""Panels of traces: samples, segments, spatial and cross-channel maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrays, dsp
from ..functions.udfs import trace_map


def samples(traces: DataFrame, column: str = "x", keys: tuple[str, ...] = ("gather", "ch")) -> DataFrame:
    """A row a sample: keys, i, x."""
    return traces.select(*keys, F.posexplode(column).alias("i", "x"))


def segments(traces: DataFrame, size: int, keys: tuple[str, ...] = ("gather", "ch")) -> DataFrame:
    """A row a whole segment of size samples: keys, seg, x. What is left over at the end is dropped."""
    count = F.floor(F.size("x") / size).cast("int")
    seg = F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1)))
    return traces.select(*keys, "x", seg.alias("seg")).select(*keys, "seg", F.slice("x", F.col("seg") * size + 1, size).alias("x"))


def channel_window(traces: DataFrame, first: int, last: int, file_first: int | None = None) -> DataFrame:
    """The rows of channels first to last of each file (file, nch, row), numbered from 0 as ch; files that lack any are left out.

    Rows are absolute from file_first if that is given, else from 0 if the file has channels beyond last, else the file holds
    just the window and its leading rows are taken.
    """
    wanted = last - first + 1
    nch, row = F.col("nch"), F.col("row")
    if file_first is not None:
        start, fits = F.lit(first - file_first), F.lit(first >= file_first) & (nch > last - file_first)
    else:
        start, fits = F.when(nch > last, first).otherwise(0), (nch > last) | (nch >= wanted)
    return traces.where(fits & (row >= start) & (row < start + wanted)).withColumn("ch", row - start)


def subtract_median(traces: DataFrame, keys: tuple[str, ...] = ("gather",)) -> DataFrame:
    """Samples less the median over the gather's channels at that time: keys, ch, i, x."""
    rows = samples(traces, keys=(*keys, "ch"))
    mid = rows.groupBy(*keys, "i").agg(F.median("x").alias("mid"))
    return rows.join(mid, [*keys, "i"]).select(*keys, "ch", "i", (F.col("x") - F.col("mid")).alias("x"))


def spatial_mean(traces: DataFrame, width: int, keys: tuple[str, ...] = ("gather",)) -> DataFrame:
    """Samples averaged over width channels around, fewer at the ends: keys, ch, i, x."""
    near = Window.partitionBy(*keys, "i").orderBy("ch").rowsBetween(-(width // 2), width // 2)
    return samples(traces, keys=(*keys, "ch")).withColumn("x", F.avg("x").over(near))


def band(column: str, fs: float, low: float | None, high: float | None, exact: bool = True, alpha: float | None = 0.05) -> Column:
    if exact:
        return trace_map(lambda m: dsp.bandpass(m, fs, low, high, alpha))(column)
    return trace_map(lambda m: dsp.spectral_bandpass(m, fs, low, high, alpha or 0.0))(column)


def whitened(column: str, fs: float, low: float, high: float, window_hz: float = 0.0, nfft: int | None = None) -> Column:
    return trace_map(lambda m: dsp.whiten(m, fs, low, high, window_hz, nfft))(column)


def decimated(column: str, fs: float, q: int, highest: float | None = None) -> Column:
    return trace_map(lambda m: dsp.decimate(m, fs, q, highest))(column)


def resampled(column: str, n: int) -> Column:
    return trace_map(lambda m: dsp.resample(m, n))(column)


def enveloped(column: str) -> Column:
    return trace_map(dsp.envelope)(column)


def amplitude(column: str, nfft: int | None = None) -> Column:
    import numpy as np

    return trace_map(lambda m: np.abs(np.fft.rfft(m, nfft)))(column)


def merged(files: DataFrame, keys: tuple[str, ...] = ("ch",)) -> DataFrame:
    """Traces of files (keys, t0, x) in order of time as one, its line taken out: keys, x."""
    parts = files.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("t0", "x"))).alias("parts"))
    whole = F.flatten(F.transform("parts", lambda p: p["x"]))
    return parts.select(*keys, whole.alias("x")).select(*keys, arrays.detrend("x").alias("x"))
