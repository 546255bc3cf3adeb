"""Base stacks of a stream of correlation samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def base_stacks(samples: DataFrame, size: str, keys: list[str], late: str = "1 hour", ts: str = "ts", value: str = "x") -> DataFrame:
    """keys, end, x, n a bin of size (like 1 day): emitted once, when the watermark has passed the bin. Rows later than that are
    dropped; the batch operator stacks a bin anew instead."""
    timed = samples.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    means = timed.groupBy(*keys, F.window(ts, size).alias("w")).agg(F.avg(value).alias("x"), F.count(value).alias("n"))
    return means.select(*keys, F.col("w.start").alias("end"), "x", "n")


def arriving_panels(spark, path: str, files_per_batch: int = 64) -> DataFrame:
    """path and content of recordings as they arrive in a folder, for operators.correlate in foreachBatch."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.npz").option("maxFilesPerTrigger", files_per_batch).load(path)
