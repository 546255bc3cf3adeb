"""Writing results so that a run can be repeated or resumed, and exporting them as text or NumPy files."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrites the partitions that df has rows of, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def pending(wanted: DataFrame, done: DataFrame, keys: list[str], lags: int | None = None) -> DataFrame:
    """The rows of wanted that done lacks; results of another length than 2 lags + 1 count as lacking."""
    good = done if lags is None else done.where(F.size("r") == 2 * lags + 1)
    return wanted.join(good.select(*keys).distinct(), keys, "left_anti")


def existing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path, or an empty one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def export_curves(curves: DataFrame, path: str) -> None:
    """Tab-separated curves, a folder for each distance: frequency and velocity to three digits."""
    out = curves.select(F.format_string("%04d", F.round("dist").cast("int")).alias("dist"), F.format_string("%.3f", "f").alias("Frequency(Hz)"), F.format_string("%.3f", "v").alias("PhaseVelocity(m/s)"))
    out.repartition("dist").sortWithinPartitions("dist", F.col("Frequency(Hz)").cast("double")).write.mode("overwrite").partitionBy("dist").option("sep", "\t").option("header", "true").csv(path)


def read_curves(spark: SparkSession, path: str) -> DataFrame:
    """dist, f, v of such folders, or of files named dispersion_<dist>m.txt."""
    schema = "f double, v double"
    rows = spark.read.schema(schema).option("sep", "\t").option("header", "true").option("comment", "#").option("recursiveFileLookup", "true").csv(path)
    name = F.col("_metadata.file_path")
    dist = F.coalesce(F.nullif(F.regexp_extract(name, r"dispersion_(\d+)m", 1), F.lit("")), F.nullif(F.regexp_extract(name, r"dist=(\d+)", 1), F.lit("")))
    return rows.select(dist.cast("int").alias("dist"), "f", "v").where(F.col("f").isNotNull() & F.col("v").isNotNull())


def as_npy(gathers: DataFrame, keys: list[str]) -> DataFrame:
    """keys, content: each gather as the bytes of a .npy file of float32 rows in order of ch, for a writer of the user's choice."""
    def run(key, frame):
        import pandas as pd

        out = io.BytesIO()
        np.save(out, np.stack(frame.sort_values("ch")["r"].to_list()).astype(np.float32))
        return pd.DataFrame({**dict(zip(keys, key, strict=True)), "content": [out.getvalue()]})

    types = ", ".join(f"{k} {gathers.schema[k].dataType.simpleString()}" for k in keys)
    return gathers.groupBy(*keys).applyInPandas(run, f"{types}, content binary")


def append_log(spark: SparkSession, path: str, rows: list[dict]) -> None:
    """Rows of a run's figures, added to a folder of JSON lines; safe for several runs at once."""
    if rows:
        spark.createDataFrame(rows).coalesce(1).write.mode("append").json(path)
