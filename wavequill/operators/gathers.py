"""Virtual source gathers: (gather, vs, ch, offset, r) with r a centred correlation. Sides, mutes, tapers, wavefield filters."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrays, dsp


def sided(gathers: DataFrame, target: str = "S1") -> DataFrame:
    """r for lags from 0 on: S1 is acausal from the source outward in order of offset and causal before it, S2 the reverse."""
    before, after = (arrays.causal("r"), arrays.acausal("r")) if target == "S1" else (arrays.acausal("r"), arrays.causal("r"))
    return gathers.withColumn("r", F.when(F.col("offset") < 0, before).otherwise(after))


def clip_side(gathers: DataFrame, side: str, near: float, far: float) -> DataFrame:
    x = F.col("offset") if side == "right" else -F.col("offset")
    return gathers.where(x.between(near, far))


def inner_mute_weight(offset, cut: float, width: float) -> Column:
    x = F.abs(arrays.col(offset))
    return F.when(x <= cut, 0.0).when(x < cut + width, 0.5 * (1 - F.cos(math.pi * (x - cut) / width))).otherwise(1.0)


def inner_mute(gathers: DataFrame, cut: float = 100.0, width: float = 50.0) -> DataFrame:
    w = inner_mute_weight("offset", cut, width)
    return gathers.withColumn("r", F.transform("r", lambda v: v * w))


def cone_mute(gathers: DataFrame, dt: float, vmin: float, vmax: float, flat: float = 0.0, before: float = 0.0, after: float = 0.0, centred: bool = False) -> DataFrame:
    """Samples whose lag lies outside the arrivals of vmin to vmax at that offset are 0."""
    x, middle = F.abs("offset"), F.floor(F.size("r") / 2) if centred else F.lit(0)
    first = F.greatest(F.lit(0.0), F.greatest(F.lit(0.0), x - flat) / vmax - before)
    last = x / vmin + after
    return gathers.withColumn("r", F.transform("r", lambda v, i: F.when((F.abs(i - middle) * dt).between(first, last), v).otherwise(0.0)))


def far_mute(gathers: DataFrame, far: float) -> DataFrame:
    return gathers.withColumn("r", F.when(F.abs("offset") > far, F.transform("r", lambda v: F.lit(0.0))).otherwise(F.col("r")))


def spatial_taper(gathers: DataFrame, alpha: float = 0.1, keys=("gather", "vs")) -> DataFrame:
    if alpha <= 0:
        return gathers
    order = Window.partitionBy(*keys).orderBy("offset", "ch")
    placed = gathers.withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    w = arrays.taper_weight(F.col("_i"), F.col("_n"), min(alpha, 1.0))
    return placed.withColumn("_w", w).withColumn("r", F.transform("r", lambda v: v * F.col("_w"))).drop("_i", "_n", "_w")


def sides(gathers: DataFrame, more_than: int = 5, keys=("gather", "vs")) -> DataFrame:
    """The traces with side right or left of the source, of sides with more than so many; the source itself is on neither."""
    side = F.when(F.col("offset") > 0, "right").when(F.col("offset") < 0, "left")
    rows = gathers.withColumn("side", side).where(F.col("side").isNotNull())
    enough = rows.groupBy(*keys, "side").agg(F.count("*").alias("_n")).where(F.col("_n") > more_than).drop("_n")
    return rows.join(enough, [*keys, "side"], "left_semi")


def _panel_map(gathers: DataFrame, kernel, keys=("gather", "vs")) -> DataFrame:
    """kernel: panel (in order of offset), offsets -> panel of the same shape."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["offset", "ch"])
        frame["r"] = list(kernel(np.stack(frame["r"].to_list()).astype(float), frame["offset"].to_numpy()))
        return frame

    return gathers.groupBy(*keys).applyInPandas(run, gathers.schema)


def fan_filter(gathers: DataFrame, dt: float, dx: float, vmin: float, vmax: float, keys=("gather", "vs"), **how) -> DataFrame:
    return _panel_map(gathers, lambda x, _: dsp.fk_filter(x, dt, dx, vmin, vmax, **how), keys)


def fk_power(gathers: DataFrame, dt: float, dx: float, keys=("gather", "vs")) -> DataFrame:
    """keys, k, f, p: magnitude of the 2-D spectrum, numbered by their place in the centred axes."""
    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["offset", "ch"])
        _, _, spectrum = dsp.fk(np.stack(frame["r"].to_list()).astype(float), dt, dx)
        rows, cols = spectrum.shape
        data = dict(zip(keys, key, strict=True))
        return pd.DataFrame({**data, "k": np.repeat(np.arange(rows), cols), "f": np.tile(np.arange(cols), rows), "p": np.abs(spectrum).ravel()})

    types = ", ".join(f"{k} {gathers.schema[k].dataType.simpleString()}" for k in keys)
    return gathers.groupBy(*keys).applyInPandas(run, f"{types}, k int, f int, p double")


def outgoing_power(gathers: DataFrame, dt: float, dx: float, fmax: float, keys=("gather", "vs")) -> DataFrame:
    """keys, k, f (cycles a metre and second), p: each side's spectrum where waves run away from the source."""
    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["offset", "ch"])
        x, offset = np.stack(frame["r"].to_list()).astype(float), frame["offset"].to_numpy()
        f, k, _ = dsp.fk(x, dt, dx)
        inside, away = (f >= 0) & (f <= fmax), -k
        power = np.zeros((len(k), int(inside.sum())))
        for side, mine in ((1, offset >= 0), (-1, offset <= 0)):
            if mine.any():
                spectrum = np.abs(dsp.fk(np.where(mine[:, None], x, 0.0), dt, dx)[2])[:, inside]
                power[away * side >= 0] += spectrum[away * side >= 0]
        data = dict(zip(keys, key, strict=True))
        return pd.DataFrame({**data, "k": np.repeat(away, power.shape[1]), "f": np.tile(f[inside], len(k)), "p": power.ravel()})

    types = ", ".join(f"{k} {gathers.schema[k].dataType.simpleString()}" for k in keys)
    return gathers.groupBy(*keys).applyInPandas(run, f"{types}, k double, f double, p double")


def directional(gathers: DataFrame, dt: float, dx: float, vmin: float, vmax: float, side: str, near: float, far: float, target: str = "S1") -> DataFrame:
    """Fan filter, one target, one side, in order away from the source."""
    kept = clip_side(sided(fan_filter(gathers, dt, dx, vmin, vmax, mode="extract"), target), side, near, far)
    return kept.withColumn("offset", F.abs("offset")) if side == "left" else kept


def polished(gathers: DataFrame, dt: float, dx: float, vmin: float, vmax: float, max_lag: int, far: float = 1e9, cut: float = 100.0, width: float = 50.0, vmax_time: float | None = None, flat: float = 0.0, before: float = 0.0, after: float = 1.0, alpha: float = 0.1, sigma: float = 3.0) -> DataFrame:
    """Fan filter, inner, far and cone mutes, taper over offsets, lags cropped."""
    out = fan_filter(gathers, dt, dx, vmin, vmax, mode="extract", smooth="gaussian", sigma=sigma)
    out = far_mute(inner_mute(out, cut, width), far)
    out = cone_mute(out, dt, vmin, vmax_time or vmax, flat, before, after, centred=True)
    return spatial_taper(out, alpha).withColumn("r", arrays.crop_lags("r", max_lag))


def targeted(gathers: DataFrame, first_vs: int, last_vs: int, max_lag: int, near: float, far: float, side: str, target: str = "S1", alpha: float = 0.1) -> DataFrame:
    """The gathers of a range of sources: one target and side, a ring of offsets, lags up to max_lag, tapered over offsets."""
    some = sided(gathers.where(F.col("vs").between(first_vs, last_vs)), target)
    kept = clip_side(some.withColumn("r", F.slice("r", 1, max_lag + 1)), side, near, far)
    return spatial_taper(kept, alpha)
