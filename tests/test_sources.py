import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavequill.operators import stacking
from wavequill.sources import archives, sinks
from wavequill.streaming import stacks


def save(path, data, **parts):
    path.parent.mkdir(parents=True, exist_ok=True)
    np.savez(path, data=data, **parts)


def test_archives(spark, tmp_path, rng):
    x = rng.standard_normal((3, 40)).astype(np.float32)
    save(tmp_path / "a/20230314_150926_site.npz", x, dt=0.005, dx=2.5, start_sample=0, end_sample=40)
    save(tmp_path / "20230316_000000_site.npz", x, dt=0.005)
    got = {r.t0: r for r in archives.read_npz(spark, str(tmp_path)).collect()}
    one = got[datetime(2023, 3, 14, 15, 9, 26)]
    assert one.fs == pytest.approx(200) and (one.nch, one.nt, one.tag, one.dx) == (3, 40, "site", 2.5)
    assert np.array_equal(np.array(one.x, np.float32).reshape(3, 40), x) and got[datetime(2023, 3, 16)].dx is None
    rows = archives.traces(archives.read_npz(spark, str(tmp_path))).where(F.col("dx") == 2.5).orderBy("row").collect()
    assert np.allclose([r.x for r in rows], x)


def test_bad_archives(spark, tmp_path):
    save(tmp_path / "20230314_000000_a.npz", np.zeros((2, 3)))
    with pytest.raises(Exception, match="has no dt"):
        archives.read_npz(spark, str(tmp_path)).collect()
    assert archives.read_npz(spark, str(tmp_path), strict=False).count() == 0
    with pytest.raises(ValueError):
        archives.decode("x", (lambda b: (np.savez(b, data=np.zeros(3), dt=1.0), b.getvalue())[1])(__import__("io").BytesIO()))


def test_zarr(spark, tmp_path):
    x = np.arange(20, dtype="<f4").reshape(4, 5)
    store = tmp_path / "20230314_000000_z.zarr"
    (store / "data").mkdir(parents=True)
    (store / "data/.zarray").write_text(json.dumps({"shape": [4, 5], "chunks": [3, 5], "dtype": "<f4", "compressor": None, "fill_value": 0, "order": "C"}))
    (store / "data/0.0").write_bytes(x[:3].tobytes())
    (store / "data/1.0").write_bytes(np.vstack([x[3:], np.zeros((2, 5), "<f4")]).tobytes())
    (store / ".zattrs").write_text(json.dumps({"dt": 0.5}))
    row = archives.read_zarr(spark, str(tmp_path)).first()
    assert row.fs == 2 and np.array_equal(np.array(row.x).reshape(4, 5), x)


def test_resume_and_partitions(spark, tmp_path):
    path = str(tmp_path / "out")
    schema = "vs int, ch int, r array<double>"
    assert sinks.existing(spark, path, schema).count() == 0
    df = spark.createDataFrame([(0, 0, [1.0] * 5), (4, 0, [1.0] * 4)], schema)
    sinks.write_partitions(df, path, ["vs"])
    sinks.write_partitions(df.where("vs = 4"), path, ["vs"])
    done = sinks.existing(spark, path, schema)
    wanted = spark.createDataFrame([(0,), (4,), (8,)], "vs int")
    assert {r.vs for r in sinks.pending(wanted, done, ["vs"], 2).collect()} == {4, 8}
    assert {r.vs for r in sinks.pending(wanted, done, ["vs"]).collect()} == {8}


def test_curve_files_and_arrays(spark, tmp_path):
    df = spark.createDataFrame([(8.0, 2.0, 300.1234), (8.0, 1.0, 310.0), (16.0, 1.0, 200.0)], "dist double, f double, v double")
    sinks.export_curves(df, str(tmp_path / "c"))
    got = sinks.read_curves(spark, str(tmp_path / "c")).orderBy("dist", "f").collect()
    assert [tuple(r) for r in got] == [(8, 1.0, 310.0), (8, 2.0, 300.123), (16, 1.0, 200.0)]
    g = spark.createDataFrame([(0, 1, [3.0, 4.0]), (0, 0, [1.0, 2.0])], "vs int, ch int, r array<double>")
    content = sinks.as_npy(g, ["vs"]).first().content
    assert np.load(__import__("io").BytesIO(bytes(content))).tolist() == [[1, 2], [3, 4]]
    sinks.append_log(spark, str(tmp_path / "log"), [{"step": "a", "sec": 1.5}])
    assert spark.read.json(str(tmp_path / "log")).count() == 1


def test_stream_of_stacks(spark, tmp_path):
    rows = [("a", datetime(2024, 1, d, h), float(h)) for d in (1, 2, 3) for h in (1, 5)]
    spark.createDataFrame(rows, "vs string, ts timestamp, x double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("vs string, ts timestamp, x double").parquet(str(tmp_path / "in"))
    query = stacks.base_stacks(stream, "1 day", ["vs"]).writeStream.format("memory").queryName("stacked").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r.end, r.x, r.n) for r in spark.table("stacked").collect()}
    batch = {(r.end, r.x, r.n) for r in stacking.base_stack(spark.createDataFrame(rows, "vs string, ts timestamp, x double"), "1d", ["vs"]).collect()}
    assert got == {r for r in batch if r[0] < datetime(2024, 1, 3)}  # the last day isn't over for the stream
