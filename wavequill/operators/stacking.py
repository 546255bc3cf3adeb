"""Stacks: means of correlations over bins of time, and over windows of bins."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNITS = {"h": 3600, "d": 86400}


def seconds(label: str) -> int | None:
    """Of a label like 7d or 12h; None for others."""
    found = re.fullmatch(r"(\d+)([hd])", label.strip().lower())
    return int(found[1]) * UNITS[found[2]] if found and int(found[1]) else None


def floor_to(ts, label: str) -> Column:
    """ts at the start of its bin, bins counted from 1970 in UTC; unchanged for a label that is none."""
    ts, size = (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"), seconds(label)
    return ts if size is None else F.timestamp_seconds(F.floor(F.unix_micros(ts) / (size * 1_000_000)) * size)


def base_stack(rows: DataFrame, label: str, keys: list[str], ts: str = "ts", value: str = "x") -> DataFrame:
    """keys, end, x, n: the mean of value over a bin. Sums are made on both sides of the shuffle."""
    return rows.groupBy(*keys, floor_to(ts, label).alias("end")).agg(F.avg(value).alias("x"), F.count(value).alias("n"))


def base_stack_arrays(rows: DataFrame, label: str, keys: list[str], size: int | None = None, ts: str = "t0", value: str = "r") -> DataFrame:
    """base_stack() of arrays, sample by sample: keys, end, r, n (see mean_arrays()). Arrays of another size are left out; size: by default that of
    most of the key's arrays, of equal ones the larger."""
    rows = rows.where(F.col(value).isNotNull()).withColumn("size", F.size(value))
    if size is None:
        of = rows.groupBy(*keys, "size").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max(F.struct("n", "size"))["size"].alias("size"))
        of = of.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("size").alias("_size"))
        rows = rows.join(of, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, "size"]], "left_semi")
    else:
        rows = rows.where(F.col("size") == size)
    binned = rows.select(*keys, floor_to(ts, label).alias("end"), F.col(value).alias("r"))
    return mean_arrays(binned, [*keys, "end"])


def mean_arrays(rows: DataFrame, keys: list[str], value: str = "r") -> DataFrame:
    """keys, r, n: the mean, sample by sample, of each key's arrays (of one length; null ones left out), and how many there are.

    Arrays are added up where they lie, batch by batch, and only the sums are brought together.
    """
    types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def sums(frames):
        for frame in frames:
            parts = [(*(k if isinstance(k, tuple) else (k,)), np.sum(np.stack(part["r"].to_list()).astype(float), axis=0), len(part)) for k, part in frame.groupby(keys, dropna=False, sort=False)]
            yield pd.DataFrame(parts, columns=[*keys, "r", "n"])

    def total(key, frame: pd.DataFrame) -> pd.DataFrame:
        n = int(frame["n"].sum())
        return pd.DataFrame([(*key, np.sum(np.stack(frame["r"].to_list()), axis=0) / n, n)], columns=[*keys, "r", "n"])

    some = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("array<double>").alias("r"))
    schema = f"{types}, r array<double>, n long"
    return some.mapInPandas(sums, schema).groupBy(*keys).applyInPandas(total, schema)


def rolling_stack_arrays(base: DataFrame, label: str, keys: list[str], min_frac: float = 0.9, unit: str = "d") -> DataFrame:
    """rolling_stack() of arrays: keys, end, r, n from base stacks (keys, end, r) of one length a key and one unit each.

    A key's stacks, one for each unit of time, are rolled in one task.
    """
    if not 0 < min_frac <= 1:
        raise ValueError(f"min_frac is a share, not {min_frac}")
    steps = seconds(label) // UNITS[unit]
    least, reach = max(1, math.ceil(steps * min_frac)), (steps - 1) * UNITS[unit]
    types = ", ".join(f"{k} {base.schema[k].dataType.simpleString()}" for k in keys)

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_s")
        at, cube = frame["_s"].to_numpy(), np.stack(frame["r"].to_list()).astype(float)
        begins = np.searchsorted(at, at - reach, side="left")
        ends = np.searchsorted(at, at, side="right")
        out = [(*key, when, cube[a:b].mean(0), int(b - a)) for when, a, b in zip(frame["end"], begins, ends, strict=True) if b - a >= least]
        return pd.DataFrame(out, columns=[*keys, "end", "r", "n"])

    timed = base.where(F.col("r").isNotNull()).select(*keys, "end", "r", F.unix_seconds(F.col("end").cast("timestamp")).alias("_s"))
    return timed.groupBy(*keys).applyInPandas(run, f"{types}, end {base.schema['end'].dataType.simpleString()}, r array<double>, n long")


def reference_arrays(rows: DataFrame, keys: list[str], value: str = "r") -> DataFrame:
    """rows with ref, the mean of the key's arrays over all times. Null keys are keys like others."""
    ref = mean_arrays(rows, keys, value).select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("r").alias("ref"))
    meets = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(ref, meets, "left").select(*rows.columns, "ref")


def run_plan(rows: DataFrame, config: dict, keys: list[str], ts: str = "t0", value: str = "r") -> DataFrame:
    """window, keys, end, r, n: all stacks that config asks for (see plan()), of arrays. Base stacks are made once, and every
    window rolls over them."""
    (label, _), *windows = plan(config)
    unit = label.strip().lower()[-1]
    if seconds(label) != UNITS[unit]:
        raise ValueError(f"base stacks of one unit are needed to roll over, not {label}")
    base = base_stack_arrays(rows, label, keys, ts=ts, value=value)
    out = base.select(F.lit(label).alias("window"), *keys, "end", "r", "n")
    for name, min_frac in windows:
        out = out.unionByName(rolling_stack_arrays(base, name, keys, min_frac, unit).select(F.lit(name).alias("window"), *keys, "end", "r", "n"))
    return out


def rolling_stack(base: DataFrame, label: str, keys: list[str], min_frac: float = 0.9, unit: str = "d", value: str = "x") -> DataFrame:
    """keys, end, x, n: the plain mean of the base stacks of a window of label's length that ends with each base stack, where
    at least min_frac of the window's units are there. Base stacks are of one unit each."""
    if not 0 < min_frac <= 1:
        raise ValueError(f"min_frac is a share, not {min_frac}")
    steps = seconds(label) // UNITS[unit]
    near = Window.partitionBy(*keys).orderBy(F.unix_seconds(F.col("end").cast("timestamp"))).rangeBetween(-(steps - 1) * UNITS[unit], 0)
    rolled = base.select(*keys, "end", F.avg(value).over(near).alias("x"), F.count(value).over(near).alias("n"))
    return rolled.where(F.col("n") >= max(1, math.ceil(steps * min_frac)))


def rolling_stack_by_steps(base: DataFrame, label: str, keys: list[str], min_frac: float = 0.9, unit: str = "d", value: str = "x") -> DataFrame:
    """rolling_stack() for base stacks of any length: members are those that lie whole units before the end, met by equality."""
    steps = seconds(label) // UNITS[unit]
    ends = base.select(*keys, "end", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("back"))
    asked = ends.withColumn("member", F.timestamp_seconds(F.unix_seconds(F.col("end").cast("timestamp")) - F.col("back") * UNITS[unit]))
    members = base.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("end").cast("timestamp").alias("member"), F.col(value).alias("v"))
    joined = asked.join(members, [asked[k].eqNullSafe(members[f"_{k}"]) for k in keys] + [asked["member"] == members["member"]])
    return joined.groupBy(*keys, "end").agg(F.avg("v").alias("x"), F.count("v").alias("n")).where(F.col("n") >= max(1, math.ceil(steps * min_frac)))


def reference(rows: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    """rows with ref, the mean over all times of the keys."""
    return rows.join(rows.groupBy(*keys).agg(F.avg(value).alias("ref")), keys)


def plan(config: dict) -> list[tuple[str, float]]:
    """[(label, min_frac)] of the windows to stack, the base first: stacking.base_stack and stacking.windows of config."""
    from ..config import get

    base, min_frac = get(config, "stacking.base_stack", "1d"), float(get(config, "stacking.min_frac", 0.9))
    if seconds(base) is None or not 0 < min_frac <= 1:
        raise ValueError("stacking.base_stack must be a label like 1d, and min_frac a share")
    asked = get(config, "stacking.windows", None) or {"7d": True, "15d": True, "30d": True}
    labels = sorted(k for k, on in (asked.items() if isinstance(asked, dict) else ((k, True) for k in asked)) if on and seconds(k))
    return [(base, 0.0)] + [(k, min_frac) for k in labels if k != base]
