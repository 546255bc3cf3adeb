"""How far results are from a reference, and statistics of repeated runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dsp

EPS = 1e-15


def paired(values: DataFrame, reference: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    """keys, v, r of what both have."""
    return values.select(*keys, F.col(value).alias("v")).join(reference.select(*keys, F.col(value).alias("r")), keys)


def per_trace(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cosine, vv, rr, dd, max_abs of the samples of each trace; two dead traces are alike."""
    sums = pairs.groupBy(*keys).agg(F.sum(F.col("v") * F.col("r")).alias("vr"), F.sum(F.col("v") * F.col("v")).alias("vv"), F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum((F.col("v") - F.col("r")) * (F.col("v") - F.col("r"))).alias("dd"), F.max(F.abs(F.col("v") - F.col("r"))).alias("max_abs"))
    both_dead = (F.sqrt("vv") < EPS) & (F.sqrt("rr") < EPS)
    cosine = F.when(both_dead, 1.0).otherwise(F.col("vr") / (F.sqrt("vv") * F.sqrt("rr") + EPS))
    return sums.select(*keys, cosine.alias("cosine"), "vv", "rr", "dd", "max_abs")


def summary(traces: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rel_fro, max_abs, cos_mean, cos_p05 over traces as per_trace() gives them."""
    rel = F.sqrt(F.sum("dd")) / (F.sqrt(F.sum("rr")) + EPS)
    return traces.groupBy(*keys).agg(rel.alias("rel_fro"), F.max("max_abs").alias("max_abs"), F.avg("cosine").alias("cos_mean"), F.percentile("cosine", 0.05).alias("cos_p05"))


def worst(summaries: DataFrame, keys: list[str]) -> DataFrame:
    return summaries.groupBy(*keys).agg(F.max("rel_fro").alias("rel_fro"), F.max("max_abs").alias("max_abs"), F.avg("cos_mean").alias("cos_mean"), F.min("cos_p05").alias("cos_p05"), F.count("*").alias("n"))


def spectral(spectra: DataFrame, fmin: float, fmax: float, keys: list[str]) -> DataFrame:
    """keys, error, leakage from spectra (keys, f, vre, vim, rre, rim): relative error in band, and what lies outside of it."""
    if not fmin < fmax:
        raise ValueError("a band has its lower edge first")
    inside = F.col("f").between(fmin, fmax)
    diff = F.pow(F.col("vre") - F.col("rre"), F.lit(2.0)) + F.pow(F.col("vim") - F.col("rim"), F.lit(2.0))
    ref, val = F.pow("rre", F.lit(2.0)) + F.pow("rim", F.lit(2.0)), F.pow("vre", F.lit(2.0)) + F.pow("vim", F.lit(2.0))
    norm = lambda x, where: F.sqrt(F.sum(F.when(where, x).otherwise(0.0)))
    return spectra.groupBy(*keys).agg((norm(diff, inside) / (norm(ref, inside) + EPS)).alias("error"), (norm(val, ~inside) / (norm(val, inside) + EPS)).alias("leakage"))


def clip_scaled(panel: DataFrame, keys: list[str], share: float = 0.995, value: str = "p") -> DataFrame:
    """value clipped at a percentile of its magnitude in the panel, and over it."""
    top = panel.groupBy(*keys).agg(F.percentile(F.abs(value), share).alias("_top"))
    x = F.try_divide(F.greatest(F.least(value, "_top"), -F.col("_top")), F.col("_top"))
    return panel.join(top, keys).withColumn(value, F.coalesce(x, F.lit(0.0))).drop("_top")


def similarity(pairs: DataFrame, keys: list[str], row: str = "v", column: str = "f", share: float = 99.5) -> DataFrame:
    """keys, ssim of panels (keys, row, column, a, b); a panel is compared in one task."""
    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        a, b = (frame.pivot(index=row, columns=column, values=c).sort_index().sort_index(axis=1).to_numpy(float) for c in ("a", "b"))
        return pd.DataFrame({**dict(zip(keys, key, strict=True)), "ssim": [dsp.ssim(a, b, share)]})

    types = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)
    return pairs.groupBy(*keys).applyInPandas(run, f"{types}, ssim double")


def pick_differences(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n and statistics of v - r, where both are numbers."""
    good = pairs.where(F.col("v").isNotNull() & F.col("r").isNotNull() & ~F.isnan("v") & ~F.isnan("r"))
    off = F.abs(F.col("v") - F.col("r"))
    rel = off / (F.abs("r") + EPS)
    return good.groupBy(*keys).agg(F.count("*").alias("n"), F.median(off).alias("median_abs"), F.sqrt(F.avg(off * off)).alias("rms"), F.percentile(off, 0.95).alias("p95_abs"), F.max(off).alias("max_abs"), F.median(rel).alias("median_rel"), F.percentile(rel, 0.95).alias("p95_rel"))


def repeat_statistics(runs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, statistics of sec from runs (keys, repeat, sec, mem): the first repeat of several is left out."""
    order, all_ = Window.partitionBy(*keys).orderBy("repeat"), Window.partitionBy(*keys)
    kept = runs.withColumn("_i", F.row_number().over(order)).withColumn("_n", F.count("*").over(all_)).where("_i > 1 or _n = 1")
    p = lambda x: F.percentile("sec", x)
    return kept.groupBy(*keys).agg(F.count("*").alias("n"), p(0.5).alias("median"), F.avg("sec").alias("mean"), F.stddev_samp("sec").alias("std"), p(0.25).alias("p25"), p(0.75).alias("p75"), p(0.95).alias("p95"), F.max("mem").alias("mem"))


def scaling(runs: DataFrame, keys: list[str]) -> DataFrame:
    """runs (keys, cores, sec) with speedup to the fewest cores, and efficiency."""
    base = runs.groupBy(*keys).agg(F.min_by("sec", "cores").alias("_base"))
    out = runs.join(base, keys).withColumn("speedup", F.col("_base") / F.col("sec")).drop("_base")
    return out.withColumn("efficiency", F.col("speedup") / F.col("cores"))


def serial_fraction(scaled: DataFrame, keys: list[str]) -> DataFrame:
    """keys, serial: the mean of Amdahl's fraction over runs of more than one core, each kept between 0 and 1."""
    p, s = F.col("cores").cast("double"), F.col("speedup")
    one = F.least(F.greatest((1 / s - 1 / p) / (1 - 1 / p), F.lit(0.0)), F.lit(1.0))
    return scaled.where("cores > 1").groupBy(*keys).agg(F.avg(one).alias("serial"))
