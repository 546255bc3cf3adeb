"""Phase velocities by frequency: images of gathers, picks, curves, depths, and their changes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dsp


def image(gathers: DataFrame, dt: float, vmin: float, vmax: float, dv: float, fmin: float, fmax: float, normalise: bool = True, keys=("gather", "vs")) -> DataFrame:
    """keys, f, v, p of gathers (keys, offset, r). A gather is one image, made in one task."""
    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        p, f, v = dsp.phase_velocity_image(np.stack(frame["r"].to_list()), frame["offset"].to_numpy(), dt, vmin, vmax, dv, fmin, fmax, normalise)
        return pd.DataFrame({**dict(zip(keys, key, strict=True)), "f": np.tile(f, len(v)), "v": np.repeat(v, len(f)), "p": p.ravel()})

    types = ", ".join(f"{k} {gathers.schema[k].dataType.simpleString()}" for k in keys)
    return gathers.groupBy(*keys).applyInPandas(run, f"{types}, f double, v double, p double")


def normalised(panel: DataFrame, keys=("gather",)) -> DataFrame:
    top = F.max("p").over(Window.partitionBy(*keys, "f"))
    return panel.withColumn("p", F.coalesce(F.try_divide("p", top), F.lit(0.0)))


def best(panel: DataFrame, keys=("gather",), below: float | None = None) -> DataFrame:
    """keys, f, v, p: each frequency's highest value, the lowest v of equal ones; below: of velocities under that."""
    some = panel if below is None else panel.where(F.col("v") < below)
    top = F.max(F.struct("p", (-F.col("v")).alias("w"))).alias("b")
    return some.groupBy(*keys, "f").agg(top).select(*keys, "f", (-F.col("b.w")).alias("v"), F.col("b.p").alias("p"))


def ridge(panel: DataFrame, references: list[float], limits: list[float], step: int = 5, lowest: float | None = None, keys=("gather",)) -> DataFrame:
    """keys, f, v: a ridge followed through each panel from the best at the reference frequencies. lowest: slower is muted."""
    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        table = frame.pivot(index="v", columns="f", values="p").sort_index().sort_index(axis=1)
        v, f = table.index.to_numpy(float), table.columns.to_numpy(float)
        p = np.where(v[:, None] < lowest, 0.0, table.to_numpy()) if lowest is not None else table.to_numpy()
        return pd.DataFrame({**dict(zip(keys, key, strict=True)), "f": f, "v": dsp.pick_curve(p, f, v, references, limits, step)})

    types = ", ".join(f"{k} {panel.schema[k].dataType.simpleString()}" for k in keys)
    return panel.groupBy(*keys).applyInPandas(run, f"{types}, f double, v double")


def interpolate(curves: DataFrame, grid: DataFrame, keys: list[str], x: str = "f", y: str = "v", on: list[str] | None = None) -> DataFrame:
    """keys, g, y: curves linearly at the points g of grid (and its columns on), nothing beyond their ends.

    Each stretch between two knots meets the points in it; the last knot itself is a stretch of its own.
    """
    order = Window.partitionBy(*keys).orderBy(x)
    knots = curves.select(*keys, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(order).alias("x1"), F.lead(y).over(order).alias("y1"))
    inside = (F.col("g") == F.col("x0")) | ((F.col("g") > F.col("x0")) & (F.col("g") < F.col("x1")))
    points = F.broadcast(grid) if not on else grid.withColumnsRenamed({k: f"_{k}" for k in on})
    for k in on or []:
        inside = inside & F.col(k).eqNullSafe(F.col(f"_{k}"))
    slope = F.coalesce(F.try_divide(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")), F.lit(0.0))
    return knots.join(points, inside).select(*keys, "g", (F.col("y0") + slope * (F.col("g") - F.col("x0"))).alias(y))


def regularise(picks: DataFrame, fmin: float, fmax: float, step: float, min_points: int = 2, keys=("dist",)) -> DataFrame:
    """keys, f, v on the grid from fmin to fmax: equal frequencies averaged, picks half a step around the band used, curves of
    fewer than two picks or min_points grid points left out. The grid is a few numbers, so it is broadcast."""
    keys = list(keys)
    mean = picks.where(F.col("f").between(fmin - step / 2, fmax + step / 2)).groupBy(*keys, "f").agg(F.avg("v").alias("v"))
    n = int(np.floor((fmax - fmin) / step + 1e-9)) + 1
    grid = picks.sparkSession.range(n).select((F.lit(float(fmin)) + F.col("id") * F.lit(float(step))).alias("g"))
    curves = interpolate(mean, grid, keys)
    counted = curves.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    enough = mean.groupBy(*keys).agg(F.count("*").alias("_m")).where(F.col("_m") >= 2).drop("_m")
    return counted.where(F.col("_n") >= min_points).join(enough, keys, "left_semi").select(*keys, F.col("g").alias("f"), "v")


def curve_change(current: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """keys, f, dvv: (current - reference) / reference at the reference's frequencies, where the current curve reaches."""
    grid = reference.select(*keys, F.col("f").alias("g"), F.col("v").alias("ref"))
    at = interpolate(current, grid.select(*keys, "g"), keys, on=keys)
    out = at.join(grid, [*keys, "g"]).select(*keys, F.col("g").alias("f"), F.try_divide(F.col("v") - F.col("ref"), F.col("ref")).alias("dvv"))
    return out.where(F.col("dvv").isNotNull() & ~F.isnan("dvv"))


def depth(v, f, factor: float = 0.333) -> Column:
    """About as deep as a wave of this velocity and frequency reaches."""
    v, f = (F.col(c) if isinstance(c, str) else c for c in (v, f))
    return v / F.when(f == 0, F.lit(1e-9)).otherwise(f) * factor


def time_lapse(curves: DataFrame, depths: list[float], keys=("vs",), factor: float = 0.333) -> DataFrame:
    """keys, ts, z, dvv: each time's change to the first one's curve, at the depths of the first's velocities, on a depth grid.
    The first time has zeros. curves: keys, ts, f, v."""
    keys = list(keys)
    first = curves.groupBy(*keys).agg(F.min("ts").alias("_t"))
    reference = curves.join(first, keys).where(F.col("ts") == F.col("_t")).select(*keys, "f", "v")
    times = curves.select(*keys, "ts").distinct()
    per_time = times.join(reference, keys).select(*keys, "ts", "f", "v")
    change = curve_change(curves, per_time, [*keys, "ts"])
    deep = change.join(reference, [*keys, "f"]).select(*keys, "ts", depth("v", "f", factor).alias("z"), "dvv")
    deep = deep.groupBy(*keys, "ts", "z").agg(F.avg("dvv").alias("dvv"))
    grid = curves.sparkSession.createDataFrame([(float(z),) for z in depths], "g double")
    return interpolate(deep, grid, [*keys, "ts"], "z", "dvv").withColumnRenamed("g", "z")
