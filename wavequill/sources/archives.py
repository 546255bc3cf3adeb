"""Recordings in NumPy archives (.npz with data, dt and, where known, dx, start_sample, end_sample) and Zarr folders."""

from __future__ import annotations

import io
import json
import warnings
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import names

PANELS = "file string, fs double, dx double, start_sample long, end_sample long, nch int, nt int, x array<float>"
#: What an archive should have besides data and dt.
RECOMMENDED = ("dx", "start_sample", "end_sample")


def decode(path: str, content: bytes) -> dict:
    """The parts of an archive. KeyError without data or dt, a warning without other parts, ValueError unless data has 2 axes."""
    with np.load(io.BytesIO(content), allow_pickle=False) as archive:
        for name in ("data", "dt"):
            if name not in archive:
                raise KeyError(f"{path} has no {name}")
        missing = [n for n in RECOMMENDED if n not in archive]
        if missing:
            warnings.warn(f"{path} has no {', '.join(missing)}", stacklevel=2)
        data = archive["data"]
        found = {n: archive[n].item() for n in ("dt", *RECOMMENDED) if n in archive}
    if data.ndim != 2:
        raise ValueError(f"{path}: data has {data.ndim} axes, not channels and samples")
    return {"data": data, **found}


def _frame(path: str, parts: dict) -> pd.DataFrame:
    data = parts["data"].astype(np.float32)
    return pd.DataFrame({"file": [path], "fs": [1 / parts["dt"]], "dx": [parts.get("dx")], "start_sample": [parts.get("start_sample")], "end_sample": [parts.get("end_sample")], "nch": [data.shape[0]], "nt": [data.shape[1]], "x": [data.ravel()]})


def read_npz(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """file, t0, tag, fs, dx, start_sample, end_sample, nch, nt, x of all .npz files under path, one row each.

    Files are read by Spark, so path may be in any store. strict: a bad file fails the job; else it is left out, with a warning.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.npz").load(path).select("path", "content")

    def run(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                try:
                    yield _frame(row.path, decode(row.path, row.content))
                except (KeyError, ValueError, zipfile.BadZipFile) as e:
                    if strict:
                        raise
                    warnings.warn(f"{row.path} left out: {e}", stacklevel=2)

    return _named(files.mapInPandas(run, PANELS))


def _descriptions(spark: SparkSession, path: str) -> list[tuple[str, str, bytes]]:
    """(store, name, content) of the stores' small files of JSON, whose names begin with a dot: Spark's readers skip those."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs, found = root.getFileSystem(spark._jsc.hadoopConfiguration()), []
    for pattern in ("*.zarr/.zattrs", "*.zarr/*/.zarray"):
        for status in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, pattern)) or []:
            stream = fs.open(status.getPath())
            try:
                content = bytes(stream.readAllBytes())
            finally:
                stream.close()
            store, _, name = status.getPath().toString().partition(".zarr/")
            found.append((f"{store}.zarr", name, content))
    return found


def read_zarr(spark: SparkSession, path: str) -> DataFrame:
    """The same of .zarr folders (format 2) directly under path, with arrays data and scalars, uncompressed or zlib.

    The driver reads the stores' descriptions, a few hundred bytes each; samples are read by Spark.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("path").contains(".zarr/"))
    store, inside = F.regexp_extract("path", r"^(.*?\.zarr)/", 1), F.regexp_extract("path", r"^.*?\.zarr/(.*)$", 1)
    chunks = files.select(store.alias("store"), inside.alias("inside"), "content").where(F.col("inside").rlike(r"/\d+(\.\d+)*$"))
    parts = chunks.unionByName(spark.createDataFrame(_descriptions(spark, path), "store string, inside string, content binary"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        content = dict(zip(frame["inside"], frame["content"], strict=True))
        found = dict(json.loads(bytes(content[".zattrs"]))) if ".zattrs" in content else {}
        for key in [k for k in content if k.endswith("/.zarray")]:
            name, meta = key.split("/")[0], json.loads(bytes(content[key]))
            shape, chunk = meta["shape"], meta["chunks"]
            out = np.full([-(-s // c) * c for s, c in zip(shape, chunk, strict=True)], meta.get("fill_value") or 0, np.dtype(meta["dtype"]))
            for at in [k for k in content if k.startswith(f"{name}/") and k != key]:
                raw = bytes(content[at])
                codec = (meta.get("compressor") or {}).get("id")
                if codec in ("zlib", "gzip"):
                    import zlib

                    raw = zlib.decompress(raw, 47)
                elif codec is not None:
                    raise ValueError(f"{at}: no decoder for {codec}")
                place = [int(p) for p in at.split("/")[-1].split(".")] if shape else []
                cut = tuple(slice(p * c, (p + 1) * c) for p, c in zip(place, chunk, strict=False))
                out[cut] = np.frombuffer(raw, np.dtype(meta["dtype"])).reshape(chunk, order=meta.get("order", "C"))
            found[name] = out[tuple(slice(s) for s in shape)] if shape else out.item()
        return _frame(frame["store"].iloc[0], found)

    return _named(parts.groupBy("store").applyInPandas(run, PANELS))


def _named(panels: DataFrame) -> DataFrame:
    base = names.base_name("file")
    tag = F.regexp_extract(base, r"^\d{8}_\d{6}_(.+?)\.\w+$", 1)
    return panels.select("file", names.stamp(base).alias("t0"), tag.alias("tag"), *[c for c in panels.columns if c != "file"])


def traces(panels: DataFrame) -> DataFrame:
    """A row a channel: file, t0, nch, row, fs, dx, x."""
    at = F.explode(F.sequence(F.lit(0), F.col("nch") - 1))
    rows = panels.select("file", "t0", "nch", "nt", "fs", "dx", "x", at.alias("row"))
    return rows.select("file", "t0", "nch", "row", "fs", "dx", F.slice("x", F.col("row") * F.col("nt") + 1, F.col("nt")).cast("array<double>").alias("x"))
