"""The numbers behind the usual figures: clips, power densities, spectrograms, residuals, interpolated sections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dsp


def scaled_by_spread(samples: DataFrame, keys=("gather",)) -> DataFrame:
    """x over the standard deviation of all samples of the panel; a dead panel stays."""
    spread = samples.groupBy(*keys).agg(F.stddev_pop("x").alias("_s"))
    return samples.join(spread, list(keys)).withColumn("x", F.col("x") / F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))).drop("_s")


def clip(samples: DataFrame, share: float, keys=("gather",), value: str = "x") -> DataFrame:
    return samples.groupBy(*keys).agg(F.percentile(F.abs(value), share).alias("clip"))


def common_clip(samples: DataFrame, share: float, keys: list[str], over: list[str], value: str = "x") -> DataFrame:
    """over, clip: the median of the clips of keys."""
    return clip(samples, share, keys, value).groupBy(*over).agg(F.median("clip").alias("clip"))


def power(traces: DataFrame, fs: float, size: int, keys=("gather", "ch")) -> DataFrame:
    """keys, k, f, p: Welch's power density of each trace."""
    names = traces.select(*keys).columns
    schema = ", ".join(f"{k} {traces.schema[k].dataType.simpleString()}" for k in names) + ", k int, f double, p double"

    def run(frames):
        for frame in frames:
            for _, part in frame.groupby(frame["x"].map(len)):
                f, p = dsp.welch(np.stack(part["x"].to_list()), fs, size)
                yield pd.DataFrame({**{n: np.repeat(part[n].to_numpy(), len(f)) for n in names}, "k": np.tile(np.arange(len(f)), len(part)), "f": np.tile(f, len(part)), "p": p.ravel()})

    return traces.select(*names, "x").mapInPandas(run, schema)


def mean_power_db(densities: DataFrame, keys=("gather",)) -> DataFrame:
    mean = densities.groupBy(*keys, "k", "f").agg(F.avg("p").alias("p"))
    return mean.select(*keys, "k", "f", (10 * F.log10(F.col("p") + 1e-12)).alias("db"))


def spectrogram(samples: DataFrame, fs: float, size: int, keys=("gather",)) -> DataFrame:
    """keys, t, k, f, db of the mean over channels of samples (keys, ch, i, x)."""
    mean = samples.groupBy(*keys, "i").agg(F.avg("x").alias("x"))
    one = mean.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("x"))
    names = list(keys)
    schema = ", ".join(f"{k} {samples.schema[k].dataType.simpleString()}" for k in names) + ", t int, k int, f double, db double"

    def run(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                f, p = dsp.spectrogram(np.asarray(row.x), fs, size)
                yield pd.DataFrame({**{n: getattr(row, n) for n in names}, "t": np.repeat(np.arange(len(p)), len(f)), "k": np.tile(np.arange(len(f)), len(p)), "f": np.tile(f, len(p)), "db": 10 * np.log10(p.ravel() + 1e-12)})

    return one.mapInPandas(run, schema)


def panel_with_picks(panels: DataFrame, picks: DataFrame, keys: list[str]) -> DataFrame:
    """All of panels, with the picked v where there is one."""
    return panels.join(picks.select(*keys, F.col("v").alias("pick")), keys, "left")


def residual(a: DataFrame, b: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    """keys, d: a less b, of what both have; met by key, not by place in a list."""
    return a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys).select(*keys, (F.col("_a") - F.col("_b")).alias("d"))


def _triangulate(points: np.ndarray) -> np.ndarray:
    """Delaunay triangles (indices) by adding points to a triangle around all."""
    n, centre, reach = len(points), points.mean(0), max(np.ptp(points, axis=0).max(), 1.0) * 1e4
    all_ = np.vstack([points, centre + reach * np.array([[-1, -1], [1, -1], [0, 1.5]])])
    triangles = [(n, n + 1, n + 2)]
    for i in range(n):
        bad = []
        for t in triangles:
            a, b, c = all_[list(t)] - all_[i]
            det = (a @ a) * (b[0] * c[1] - c[0] * b[1]) - (b @ b) * (a[0] * c[1] - c[0] * a[1]) + (c @ c) * (a[0] * b[1] - b[0] * a[1])
            turn = (all_[t[1]] - all_[t[0]])[0] * (all_[t[2]] - all_[t[0]])[1] - (all_[t[1]] - all_[t[0]])[1] * (all_[t[2]] - all_[t[0]])[0]
            if det * np.sign(turn) > 0:
                bad.append(t)
        edges = [e for t in bad for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))]
        outer = [e for e in edges if (e[1], e[0]) not in edges]
        triangles = [t for t in triangles if t not in bad] + [(*e, i) for e in outer]
    return np.array([t for t in triangles if max(t) < n]).reshape(-1, 3)


def interpolated_section(points: DataFrame, nx: int = 200, nz: int = 200, keys=("line",)) -> DataFrame:
    """keys, x, z, v: scattered values linearly on a grid over their extent; null outside their hull. One section a task."""
    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        p, v = frame[["x", "z"]].to_numpy(float), frame["v"].to_numpy(float)
        p, first = np.unique(p, axis=0, return_index=True)
        v = v[first]
        gx, gz = np.meshgrid(np.linspace(p[:, 0].min(), p[:, 0].max(), nx), np.linspace(p[:, 1].min(), p[:, 1].max(), nz))
        grid, out = np.stack([gx.ravel(), gz.ravel()], 1), np.full(nx * nz, np.nan)
        scale = np.maximum(np.ptp(p, axis=0), 1e-12)
        for t in _triangulate((p - p.min(0)) / scale) if len(p) >= 3 else []:
            a, b, c = p[t]
            m = np.array([b - a, c - a]).T
            if abs(np.linalg.det(m)) < 1e-14:
                continue
            w = np.linalg.solve(m, (grid - a).T)
            inside = (w.min(0) >= -1e-9) & (w.sum(0) <= 1 + 1e-9)
            out[inside] = v[t[0]] + w[0, inside] * (v[t[1]] - v[t[0]]) + w[1, inside] * (v[t[2]] - v[t[0]])
        return pd.DataFrame({**dict(zip(keys, key, strict=True)), "x": grid[:, 0], "z": grid[:, 1], "v": out})

    types = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)
    return points.groupBy(*keys).applyInPandas(run, f"{types}, x double, z double, v double").withColumn("v", F.nanvl("v", F.lit(None)))
