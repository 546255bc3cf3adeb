"""The driver's tables in the roles of recordings: traces, correlations, picks, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Samples a second and metres a channel that the traces are taken to have; the channel that is the source of a gather.
FS, DX, SOURCE = 64.0, 1.0, 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel(spark, sf_dir) -> DataFrame:
    """gather, ch, r, x: embeddings as traces, a label a gather; r numbers the traces of a gather."""
    order = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("gather"), F.col("vec_id").alias("ch"), (F.row_number().over(order) - 1).alias("r"), F.col("embedding").cast("array<double>").alias("x"))


def gathers(spark, sf_dir) -> DataFrame:
    """gather, vs, ch, offset, r: the first 63 samples as a centred correlation with channel SOURCE."""
    return panel(spark, sf_dir).select("gather", F.lit(SOURCE).alias("vs"), "ch", ((F.col("r") - SOURCE) * DX).alias("offset"), F.slice("x", 1, 63).alias("r"))


def stream(spark, sf_dir) -> DataFrame:
    """vs, ch, user, ts, x: events as samples of correlations."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("vs"), (F.col("user_id") % 16).alias("ch"), F.col("user_id").alias("user"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("x"))


def picks(spark, sf_dir) -> DataFrame:
    """dist, f, v, state: orders as picks of dispersion curves."""
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("dist"), (F.col("o_orderkey") % 97 / 10.0 + 0.1).alias("f"), (F.col("o_totalprice") / 1000 + 100).alias("v"), F.col("o_orderstatus").alias("state"))


def models(spark, sf_dir) -> DataFrame:
    """station, model, layer, h, vs, misfit: line items as layers of an order's model."""
    t = table(spark, sf_dir, "lineitem")
    return t.groupBy((F.col("l_orderkey") % 5).alias("station"), F.col("l_orderkey").alias("model"), F.col("l_linenumber").cast("long").alias("layer")).agg(F.min("l_quantity").alias("h"), F.min("l_extendedprice").alias("vs"), ((F.col("l_orderkey") * 7919 % 10007) / 100.0).alias("misfit"))
