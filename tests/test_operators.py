import os
import threading
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavequill import config, names
from wavequill.functions import arrays, dsp
from wavequill.operators import correlate, delays, diagnostics, fidelity, gathers, imaging, inversion, stacking, traces
from wavequill.plans import catalogue, planner


def frame(spark, panel, gather="g"):
    return spark.createDataFrame([(gather, c, c, [float(v) for v in row]) for c, row in enumerate(panel)], "gather string, ch int, r int, x array<double>")


def matrix(df, value="x"):
    return np.array([r[value] for r in df.orderBy("gather", "ch").collect()])


def test_column_maps_are_the_kernels(spark, rng):
    x = rng.standard_normal((5, 41)) + np.arange(41)
    df = frame(spark, x)
    for column, want in (
        (arrays.detrend("x"), dsp.detrend(x)),
        (arrays.gradient("x", 10.0), np.gradient(x, axis=-1) * 10),
        (arrays.running_absolute_mean("x", 8), dsp.running_absolute_mean(x, 8)),
        (arrays.taper("x", 0.3), x * dsp.tukey(41, 0.3)),
        (arrays.fold("x"), (x[:, 20::-1] + x[:, 20:]) / 2),
        (arrays.normalise("x"), x / np.abs(x).max(-1, keepdims=True)),
    ):
        assert np.allclose(matrix(df.withColumn("x", column)), want)


def test_maps_of_null_empty_and_dead_traces(spark):
    df = spark.createDataFrame([(0, None), (1, []), (2, [0.0, 0.0]), (3, [5.0])], "ch int, x array<double>")
    for column in (arrays.detrend("x"), arrays.gradient("x"), arrays.running_absolute_mean("x", 3), arrays.normalise("x"), arrays.z_score("x"), traces.enveloped("x")):
        rows = df.select(column.alias("x")).collect()
        assert rows[0]["x"] is None and len(rows) == 4


def test_kernels_take_traces_of_several_lengths(spark, rng):
    df = spark.createDataFrame([(i, [float(v) for v in rng.standard_normal(n)]) for i, n in enumerate((64, 80, 64))], "ch int, x array<double>")
    assert [len(r["x"]) for r in df.withColumn("x", traces.resampled("x", 32)).orderBy("ch").collect()] == [32, 32, 32]


@pytest.fixture
def soon(spark):
    """Jobs that take longer are cancelled, and fail."""
    timer = threading.Timer(40, spark.sparkContext.cancelAllJobs)
    timer.start()
    yield
    timer.cancel()


def test_long_merged_traces(spark, rng, soon):
    x = rng.standard_normal((2, 20000)) + np.arange(20000) / 500
    files = spark.createDataFrame([(0, t, row.tolist()) for t, row in ((1, x[1]), (0, x[0]))], "ch int, t0 int, x array<double>")
    assert np.allclose(traces.merged(files).first()["x"], dsp.detrend(x.ravel()[None])[0])


def test_long_z_scores(spark, rng, soon):
    x = rng.standard_normal((2, 1500))
    assert np.allclose(matrix(frame(spark, x).withColumn("x", arrays.z_score("x"))), (x - x.mean(1, keepdims=True)) / x.std(1, ddof=1, keepdims=True))


def test_correlation_forms_agree(spark, rng):
    df = frame(spark, rng.standard_normal((7, 70)))
    cut = traces.segments(df, 32, ("gather", "r", "ch"))
    one = {(r.vs, r.ch, r.lag): r.r for r in correlate.pairs_by_lag(cut, 3, 5).collect()}
    for method in ("block", "conventional", None):
        rows = correlate.correlate_traces(cut, 3, 5, method, per_task=2).select("vs", "ch", F.posexplode("r").alias("i", "v")).collect()
        assert len(rows) == len(one) == 3 * 7 * 11
        assert max(abs(one[r.vs, r.ch, r.i - 5] - r.v) for r in rows) < 1e-9


def test_direct_sums_of_uneven_traces(spark, rng, monkeypatch):
    """Block against block, with nulls, missing and short segments and a repeated channel, against a join of samples."""
    x = rng.standard_normal((2, 23, 2, 9))
    rows = [(g, c, c if c < 22 or g else 3, s, [float(v) for v in x[g, c, s]]) for g in (0, 1) for c in range(23) for s in (0, 1)]
    rows = [r for r in rows if r[:4] != (0, 4, 4, 1)]
    rows[7] = (*rows[7][:4], [None, 2.0, None])
    rows[9] = (*rows[9][:4], [None] * 9)
    cut = spark.createDataFrame(rows, "gather int, r int, ch int, seg int, x array<double>")
    want = {}
    for g, r, vs, s, a in rows:
        for h, _, ch, q, b in rows:
            if r % 5 == 0 and (g, s) == (h, q):
                for i in range(len(a)):
                    for j in range(max(0, i - 3), min(len(b), i + 4)):
                        want.setdefault((g, vs, ch, j - i), []).append(None if a[i] is None or b[j] is None else a[i] * b[j] / 2)
    want = {k: sum(p) if (p := [z for z in v if z is not None]) else None for k, v in want.items()}
    monkeypatch.setattr(correlate.blocks, "side_for", lambda *a: 4)
    direct = correlate.pairs_by_lag(cut, 5, 3)
    got = {(r.gather, r.vs, r.ch, r.lag): r.r for r in direct.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    assert None in got.values()
    best = {(r.gather, r.vs, r.ch): (r.lag, r.r) for r in correlate.peak_pairs(cut, 5, 3).collect()}
    assert best == {(r.gather, r.vs, r.ch): (r.lag, r.r) for r in correlate.peaks(direct).collect()}


def test_pairs_by_lag_shuffle_traces_and_no_products(spark, rng):
    cut = traces.segments(frame(spark, rng.standard_normal((3, 70))), 32, ("gather", "r", "ch"))
    for found in (correlate.pairs_by_lag(cut, 3, 5), correlate.peak_pairs(cut, 3, 5)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "sum(" not in plan and "FlatMapGroupsInArrow" in plan


def test_registered_peaks_need_no_row_for_each_lag(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables here")
    plan = catalogue.QUERIES["xcorr_peak"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") and "max(" not in plan


def test_panels_end_to_end(spark, rng):
    """Six channels of 40 s at 25 samples a second, in segments of 8 s, with two virtual sources."""
    t0, x = datetime(2023, 3, 14), rng.standard_normal((6, 1000))
    panels = spark.createDataFrame([("a.npz", t0, 25.0, 6, x.ravel().tolist()), ("short.npz", t0, 25.0, 6, x[:, :150].ravel().tolist()), ("few.npz", t0, 25.0, 3, x[:3].ravel().tolist())], "file string, t0 timestamp, fs double, nch int, x array<float>")
    settings = {"data": {"fs_raw": 25, "first_chan": 0, "last_chan": 5, "src_stride": 3, "min_length_sec": 30}, "preprocess": {"f1": 1, "f2": 6}, "xcorr": {"max_lag_sec": 1.2, "xcorr_seg_sec": 8}}
    one = {(r.vs, r.ch): np.array(r.r) for r in correlate.correlate_panels(panels, settings).collect()}
    assert set(one) == {(v, c) for v in (0, 3) for c in range(6)} and all(len(r) == 61 for r in one.values())
    settings["xcorr"]["mode"] = "v1"
    two = {(r.vs, r.ch): np.array(r.r) for r in correlate.correlate_panels(panels, settings).collect()}
    assert all(np.allclose(one[k], two[k], atol=1e-6 * np.abs(one[k]).max()) for k in one)
    settings["xcorr"]["auto_cc"] = True
    auto = correlate.correlate_panels(panels, settings).collect()
    assert len(auto) == 6 and all(r.vs == -1 and np.argmax(r.r) == 30 for r in auto)


def test_floor_and_base_stack(spark):
    rows = [(datetime(2024, 1, 1, h), 0, float(h)) for h in range(4)] + [(datetime(2024, 1, 3, 1), 0, 7.0)]
    df = spark.createDataFrame(rows, "ts timestamp, vs int, x double")
    got = {(r.end, r.x, r.n) for r in stacking.base_stack(df, "1d", ["vs"]).collect()}
    assert got == {(datetime(2024, 1, 1), 1.5, 4), (datetime(2024, 1, 3), 7.0, 1)}
    two = df.select(stacking.floor_to("ts", "2d").alias("f")).distinct().collect()
    assert {r.f for r in two} == {datetime(2023, 12, 31), datetime(2024, 1, 2)}
    assert df.select(stacking.floor_to("ts", "2w").alias("f")).where(F.col("f") == F.lit(datetime(2024, 1, 1, 3))).count() == 1


def test_array_stack_leaves_other_lengths_out(spark):
    rows = [(datetime(2024, 1, 1, h), 0, [1.0 * h] * n) for h, n in ((0, 3), (1, 3), (2, 2))] + [(datetime(2024, 1, 1), 1, None)]
    got = stacking.base_stack_arrays(spark.createDataFrame(rows, "t0 timestamp, vs int, r array<double>"), "1d", ["vs"]).collect()
    assert [(r.vs, r.r, r.n) for r in got] == [(0, [0.5] * 3, 2)]


def test_rolling_stack_and_coverage(spark):
    days = [d for d in range(12) if d not in (4,)]
    base = spark.createDataFrame([(0, datetime(2024, 1, 1) + timedelta(days=d), float(d)) for d in days], "vs int, end timestamp, x double")
    for roll in (stacking.rolling_stack, stacking.rolling_stack_by_steps):
        got = {r.end.day - 1: (r.x, r.n) for r in roll(base, "7d", ["vs"], 0.85).collect()}
        want = {d: [k for k in range(d - 6, d + 1) if k in days] for d in days}
        assert got == {d: (pytest.approx(np.mean(w)), len(w)) for d, w in want.items() if len(w) >= 6}
    with pytest.raises(ValueError):
        stacking.rolling_stack(base, "7d", ["vs"], 1.5)
    assert stacking.plan({"stacking": {"windows": {"7d": True, "15d": False, "x": True}}}) == [("1d", 0.0), ("7d", 0.9)]


def test_stacks_of_arrays(spark, rng):
    """Means of whole arrays by day, over a week of days of which some are missing, and over all time; by key, null keys too."""
    days, r = [0, 1, 2, 4, 5, 6, 9], rng.standard_normal((3, 7, 2, 5))
    rows = [(vs, datetime(2024, 5, 1, 3 * h) + timedelta(days=d), r[k, j, h].tolist()) for k, vs in enumerate((0, 4, None)) for j, d in enumerate(days) for h in range(2)]
    rows += [(0, datetime(2024, 5, 1), None), (0, datetime(2024, 5, 2), [1.0])]
    df = spark.createDataFrame(rows, "vs int, t0 timestamp, r array<double>").repartition(3)
    config = {"stacking": {"base_stack": "1d", "min_frac": 0.7, "windows": {"7d": True}}}
    got = {(x.window, x.vs, x.end): (x.n, x.r) for x in stacking.run_plan(df, config, ["vs"]).collect()}
    want = {}
    for k, vs in enumerate((0, 4, None)):
        for j, d in enumerate(days):
            end = datetime(2024, 5, 1) + timedelta(days=d)
            want["1d", vs, end] = (2, r[k, j].mean(0))
            near = [i for i, x in enumerate(days) if d - 6 <= x <= d]
            if len(near) >= 5:
                want["7d", vs, end] = (len(near), r[k, near].mean((0, 1)))
    assert set(got) == set(want) and all(got[k][0] == n and np.allclose(got[k][1], m) for k, (n, m) in want.items())
    base = stacking.base_stack_arrays(df, "1d", ["vs"])
    ref = stacking.reference_arrays(base, ["vs"]).collect()
    assert len(ref) == 21 and all(np.allclose(x.ref, r[(0, 4, None).index(x.vs)].mean((0, 1))) for x in ref)
    none = df.limit(0)
    assert stacking.run_plan(none, config, ["vs"]).count() == 0 and stacking.reference_arrays(none, ["vs"]).count() == 0
    for bad in ({"base_stack": "2d", "windows": {"7d": True}}, {"base_stack": "1d", "min_frac": 2}):
        with pytest.raises(ValueError):
            stacking.run_plan(df, {"stacking": bad}, ["vs"])


def test_attenuation_by_side(spark):
    """Each side's own quality factor, where enough live traces are; a dead trace counts for nothing."""
    f, speed, q = np.fft.rfftfreq(256, 0.01), 300.0, {"right": 25.0, "left": 60.0}
    rows = []
    for side, sign, n in (("right", 1, 7), ("left", -1, 6)):
        for k in range(1, n + 1):
            x = np.fft.irfft(np.exp(-np.pi * f * 15.0 * k / (q[side] * speed)))
            rows.append(("g", 0, sign * 15.0 * k, x.tolist()))
    rows += [("g", 0, 0.0, [1.0] * 256), ("g", 0, 500.0, [0.0] * 256)] + [("few", 0, 15.0 * k, [1.0] * 128 + [0.0] * 128) for k in range(1, 6)]
    df = spark.createDataFrame(rows, "gather string, vs int, offset double, r array<double>")
    got = {r.side: r for r in delays.attenuation_by_side(df, 100.0, speed, 1, 5.0, 30.0).collect()}
    assert {s: (r.gather, r.n) for s, r in got.items()} == {"right": ("g", 7), "left": ("g", 6)}
    assert all(got[s].q == pytest.approx(q[s], rel=1e-6) and got[s].r2 == pytest.approx(1) for s in q)


def test_median_segments_and_channel_window(spark, rng):
    x = rng.standard_normal((4, 10))
    got = traces.subtract_median(frame(spark, x)).collect()
    assert max(abs(r.x - (x - np.median(x, 0))[r.ch, r.i]) for r in got) < 1e-12
    assert traces.segments(frame(spark, x), 4).count() == 8 and traces.segments(frame(spark, x), 11).count() == 0
    rows = spark.createDataFrame([(f, n, r) for f, n in (("all", 12), ("cut", 5), ("few", 3)) for r in range(n)], "file string, nch int, row int")
    kept = {(r.file, r.row): r.ch for r in traces.channel_window(rows, 6, 10).collect()}
    assert kept == {("all", r): r - 6 for r in range(6, 11)} | {("cut", r): r for r in range(5)}
    assert {r.file for r in traces.channel_window(rows, 6, 10, file_first=4).collect()} == {"all"}


def test_gathers(spark, rng):
    r = rng.standard_normal((13, 21))
    df = spark.createDataFrame([("g", 6, c, float(c - 6), [float(v) for v in row]) for c, row in enumerate(r)], "gather string, vs int, ch int, offset double, r array<double>")
    s1 = {x.ch: x.r for x in gathers.sided(df, "S1").collect()}
    assert np.allclose(s1[0], r[0, 10:]) and np.allclose(s1[12], r[12, 10::-1])
    assert [x.ch for x in gathers.clip_side(df, "left", 2, 4).orderBy("ch").collect()] == [2, 3, 4]
    assert gathers.sides(df).groupBy("side").count().count() == 2 and gathers.sides(df, 6).count() == 0
    muted = {x.ch: x.r for x in gathers.inner_mute(df, 2, 2).collect()}
    assert not np.any(muted[6]) and np.allclose(muted[0], r[0]) and np.allclose(muted[9], r[9] * 0.5)
    both = [matrix(gathers.fan_filter(df, 0.01, 1.0, 5, 50, mode=m, smooth="no"), "r") for m in ("extract", "eliminate")]
    assert np.allclose(sum(both), r)
    out = gathers.polished(df, 0.01, 1.0, 5, 50, 8, cut=1, width=1)
    assert {len(x.r) for x in out.collect()} == {17}
    assert gathers.outgoing_power(df, 0.01, 1.0, 20.0).where("p < 0").count() == 0


def test_image_and_picks(spark):
    t = np.arange(256) * 0.01
    rows = [("g", 0, c, 2.0 * c, [float(v) for v in np.exp(-(((t - 0.6 - 2 * c / 100) / 0.02) ** 2))]) for c in range(30)]
    df = spark.createDataFrame(rows, "gather string, vs int, ch int, offset double, r array<double>")
    image = imaging.image(df, 0.01, 50.0, 200.0, 5.0, 4.0, 14.0)
    assert all(abs(r.v - 100) <= 10 for r in imaging.best(image, ("gather", "vs")).collect())
    assert all(abs(r.v - 100) <= 10 for r in imaging.ridge(image, [8.0], [180.0], 2, keys=("gather", "vs")).collect())


def test_curves(spark):
    """Changes of a curve against another on the frequencies both have, gaps filled along a line, depths of a share of the wavelength."""
    f = [1.0, 1.5, 2.5, 4.0, 6.0, 9.0]
    slower = [(s, x, 900 / (1 + x) * factor) for s, factor in (("up", 1.03), ("down", 0.96)) for x in f]
    now = spark.createDataFrame(slower, "k string, f double, v double")
    ref = spark.createDataFrame([(s, x, 900 / (1 + x)) for s in ("up", "down") for x in f], "k string, f double, v double")
    got = imaging.curve_change(now, ref, ["k"]).collect()
    assert len(got) == 12 and all(r.dvv == pytest.approx(0.03 if r.k == "up" else -0.04) for r in got)
    part = imaging.curve_change(now, ref.where("k = 'up' and f >= 2 and f < 7"), ["k"]).collect()
    assert sorted(r.f for r in part) == [2.5, 4.0, 6.0]
    picks = spark.createDataFrame([(3, 2.0, 500.0), (3, 2.0, 520.0), (3, 2.0, 540.0), (3, 8.0, 220.0), (4, 2.0, 7.0)], "dist int, f double, v double")
    filled = {(r.dist, r.f): r.v for r in imaging.regularise(picks, 2, 8, 1.5, 2).collect()}
    assert filled == {(3, 2.0): 520.0, (3, 3.5): 445.0, (3, 5.0): 370.0, (3, 6.5): 295.0, (3, 8.0): 220.0}
    z = [r.z for r in spark.createDataFrame([(4.0, 240.0), (0.5, 90.0), (0.0, 90.0)], "f double, v double").select(imaging.depth(F.col("v"), F.col("f"), 0.4).alias("z")).collect()]
    assert z[:2] == pytest.approx([24, 72]) and np.isfinite(z[2])


def test_time_lapse_of_a_uniform_change(spark):
    rows = [(v, datetime(2024, 1, d), float(f), (400.0 - 20 * f) * (1 + 0.01 * (d - 1))) for v in (0, 4) for d in (1, 2, 3) for f in range(2, 9)]
    got = imaging.time_lapse(spark.createDataFrame(rows, "vs int, ts timestamp, f double, v double"), [15.0, 20.0, 30.0]).collect()
    assert len(got) == 2 * 3 * 3 and all(abs(r.dvv - 0.01 * (r.ts.day - 1)) < 1e-9 for r in got)


def test_changes(spark):
    t = np.arange(600)
    wave = lambda e: np.sin(t * (1 + e) * 0.3) * np.exp(-((t * (1 + e) - 300) ** 2) / 20000)
    rows = [(k, [float(v) for v in wave(e)], [float(v) for v in wave(0)]) for k, e in enumerate((-0.02, 0.0, 0.01))]
    got = {r.k: (r.eps, r.cc) for r in delays.stretch(spark.createDataFrame(rows, "k int, x array<double>, ref array<double>"), 0.03, 61).collect()}
    assert [got[k][0] for k in range(3)] == pytest.approx([-2, 0, 1], abs=0.11) and all(c > 0.95 for _, c in got.values())
    rows = [("x", 2.0, 0.7), ("x", 4.0, 0.8), ("x", 30.0, 0.9), ("x", 6.0, 0.3), ("y", -1.5, 0.55), ("z", 1.0, 0.1)]
    agg = {r.k: (r.n_pairs, r.dvv_mean) for r in delays.aggregate(spark.createDataFrame(rows, "k string, eps double, cc double"), 0.5, 10.0, ("k",)).collect()}
    assert agg == {"x": (2, 3.0), "y": (1, -1.5), "z": (0, None)}


def test_shift_changes(spark):
    base = np.exp(-((np.arange(101) - 50) ** 2) / 20)
    rows = [(10.0, np.roll(base, -3).tolist(), base.tolist()), (0.5, base.tolist(), base.tolist()), (5.0, [0.0] * 101, base.tolist())]
    got = delays.delay_changes(spark.createDataFrame(rows, "offset double, x array<double>, ref array<double>"), 0.01, 100.0).collect()
    assert len(got) == 1 and got[0].lag == 3 and got[0].dvv == pytest.approx(0.3)


def test_channel_delays(spark):
    t = (np.arange(256) - 128) * 0.01
    x = np.stack([np.exp(-(((t - s * 0.01) * 12) ** 2)) for s in (0, 3, -2, 1)])
    got = {r.ch: r.delay for r in delays.channel_delays(frame(spark, x), 0.01, 0.5).collect()}
    assert [got[c] for c in range(4)] == pytest.approx([-0.005, 0.025, -0.025, 0.005], abs=1e-6)


def test_pair_lags_block_against_block(spark, rng, monkeypatch):
    """F8"""
    monkeypatch.setattr(delays, "SAMPLES", 1)
    monkeypatch.setattr(delays.blocks, "within", lambda rows, keys, most, f=delays.blocks.within: f(rows, keys, 4))
    x = rng.standard_normal((19, 32))
    got = {(r.i, r.j): (r.cc, r.lag) for r in delays.pair_lags(frame(spark, x), 0.5).collect()}
    cc, lag = dsp.pair_delays(x, 0.5)
    assert got.keys() == {(i, j) for j in range(19) for i in range(j)}
    assert all(a == pytest.approx(cc[k]) and b == lag[k] for k, (a, b) in got.items())


def test_delays_block_against_block(spark, rng, monkeypatch):
    """F7"""
    monkeypatch.setattr(delays.blocks, "within", lambda rows, keys, most, f=delays.blocks.within: f(rows, keys, 4))
    x = rng.standard_normal((19, 32))
    cc, lag = dsp.pair_delays(x, 0.5)
    for cc_min, damp in ((0.2, 0.1), (0.45, 0.0), (2.0, 0.0)):  # few pairs, so that there are several connected parts; none
        i, j = np.nonzero(np.triu(cc > cc_min, 1))
        got = {r.ch: r.delay for r in delays.channel_delays(frame(spark, x), 0.5, cc_min, damp).collect()}
        assert [got[c] for c in range(19)] == pytest.approx(dsp.solve_delays(i, j, lag[i, j], 19, damp).tolist(), abs=1e-9)


def test_windowed_delays_block_against_block(spark, rng, monkeypatch):
    """F1"""
    x = rng.standard_normal((13, 63))
    gathers_ = frame(spark, x).select("gather", F.lit(0).alias("vs"), "ch", F.col("x").alias("r"))
    run = lambda: {(r.window, r.ch): (r.delay, r.relative, r.cc, r.error) for r in delays.windowed_delays(gathers_, 64.0, [(0.05, 0.3, 0.15), (0.1, 0.45, 0.25)], 0.5, 3).collect()}
    whole = run()
    monkeypatch.setattr(delays.blocks, "within", lambda rows, keys, most, f=delays.blocks.within: f(rows, keys, 4))
    got = run()
    assert got.keys() == whole.keys() and all(got[k] == pytest.approx(whole[k], abs=1e-9, nan_ok=True) for k in whole)
    # The second window by hand.
    r = np.stack([x[max(0, c - 1) : c + 2].mean(0) for c in range(13)])
    y = dsp.resample(dsp.bandpass((r[:, 31::-1] + r[:, 31:]) / 2, 64.0, 0.5 / 0.35, 2 / 0.35, None), 32 * 15)[:, 96:433]
    cc, lag = dsp.pair_delays(y * dsp.tukey(337, 0.5), 1 / 960)
    i, j = np.nonzero(np.triu(cc > 0.5, 1))
    want = dsp.solve_delays(i, j, lag[i, j], 13)
    off = (want[i] - want[j] - lag[i, j]) ** 2
    np.fill_diagonal(cc, np.nan)
    for c in range(13):
        error = np.sqrt(off[(i == c) | (j == c)].mean()) if ((i == c) | (j == c)).any() else np.nan
        assert got[1, c] == pytest.approx((want[c], want[c] / 0.25, np.nanmean(cc[c]), error), abs=1e-9, nan_ok=True)


def test_fidelity(spark, rng):
    """A panel that is a quarter too weak, traces that are dead, and picks that are missing."""
    x = rng.integers(1, 9, (5, 4)).astype(float)
    pairs = spark.createDataFrame([("a", i, j, float(0.75 * x[i, j]), float(x[i, j])) for i in range(5) for j in range(4)], "g string, t int, i int, v double, r double")
    s = fidelity.summary(fidelity.per_trace(pairs, ["g", "t"]), ["g"]).first()
    assert s.rel_fro == pytest.approx(0.25) and s.max_abs == pytest.approx(0.25 * x.max()) and s.cos_mean == pytest.approx(1)
    dead = spark.createDataFrame([(7, 0.0, 0.0), (8, -2.0, 0.0), (9, 3.0, -3.0)], "t int, v double, r double")
    assert {r.t: r.cosine for r in fidelity.per_trace(dead, ["t"]).collect()} == pytest.approx({7: 1.0, 8: 0.0, 9: -1.0})
    picks = spark.createDataFrame([("k", 10.0, 14.0), ("k", 3.0, float("nan")), ("k", 8.0, None), ("k", 5.0, 4.0), ("k", 6.0, 6.5)], "k string, v double, r double")
    p = fidelity.pick_differences(picks, ["k"]).first()
    assert (p.n, p.median_abs, p.max_abs) == (3, 1.0, 4.0)


def test_run_statistics(spark):
    runs = spark.createDataFrame([("a", i, s, 1.0) for i, s in enumerate((9.0, 1.0, 3.0))] + [("b", 0, 4.0, 2.0)], "k string, repeat int, sec double, mem double")
    got = {r.k: (r.n, r.median) for r in fidelity.repeat_statistics(runs, ["k"]).collect()}
    assert got == {"a": (2, 2.0), "b": (1, 4.0)}
    cores = spark.createDataFrame([("a", 1, 8.0), ("a", 2, 5.0), ("a", 4, 3.5)], "k string, cores int, sec double")
    scaled = fidelity.scaling(cores, ["k"])
    assert scaled.where("cores = 4").first().speedup == pytest.approx(8 / 3.5)
    assert fidelity.serial_fraction(scaled, ["k"]).first().serial == pytest.approx(0.25)
    length, blocks = planner.shape(15000, 250, "block")
    cost = planner.costs(spark.createDataFrame([(16, 152, 10, length, blocks)], "n_vs int, nch int, nseg int, fft_length int, blocks int")).first()
    assert cost.flops / 1e9 == pytest.approx(15.28, abs=0.01) and cost.n_corr == 2432


def test_models(spark):
    rows = [(0, m, layer, float(h), 100.0 * (layer + 1) + m, float(10 - m)) for m in range(10) for layer, h in enumerate((10, 20, 0))]
    models = spark.createDataFrame(rows, "station int, model int, layer int, h double, vs double, misfit double")
    best = inversion.best_share(models, 20.0)
    assert {r.model for r in best.collect()} == {9, 8, 7}
    assert inversion.mean_model(best).where("layer = 0").first().vs == pytest.approx(108)
    z = {r.z: r.vs for r in inversion.on_depths(models.where("model = 0"), [0, 9.9, 10, 29, 30, 500]).collect()}
    assert z == {0: 100, 9.9: 100, 10: 200, 29: 200, 30: 300, 500: 300}


def test_forward_model_and_inversion(spark):
    h, vs, rho = np.array([10.0]), np.array([150.0, 400.0]), np.array([2000.0, 2000.0])
    f = np.array([1.0, 3.0, 8.0, 30.0])
    c = inversion.love_wave_velocity(h, vs, rho, f)
    k = 2 * np.pi * f
    left = np.tan(k * h[0] * np.sqrt(1 / vs[0] ** 2 - 1 / c**2))
    right = vs[1] ** 2 * np.sqrt(1 / c**2 - 1 / vs[1] ** 2) / (vs[0] ** 2 * np.sqrt(1 / vs[0] ** 2 - 1 / c**2))
    assert np.allclose(left, right, rtol=1e-4) and (np.diff(c) < 0).all()
    curve = spark.createDataFrame([(0, float(a), float(b)) for a, b in zip(f, c, strict=True)], "station int, f double, v double")
    got = inversion.invert(curve, [(5, 20, 100, 250), (0, 0, 250, 600)], runs=1, particles=12, steps=25)
    assert got.agg(F.min("misfit")).first()[0] < 20
    layers = spark.createDataFrame([(0, 0, 10.0, 150.0), (0, 1, 0.0, 400.0)], "station int, layer int, h double, vs double")
    s = {(r.layer, r.f): r.s for r in inversion.sensitivity(layers, [1.0, 30.0]).collect()}
    assert s[0, 30.0] > 0.9 and s[1, 1.0] > s[1, 30.0]


def boundary_gap(c, f, h, vs, vp):
    """The least singular value of the boundary conditions of one layer over a half-space: 0 for a Rayleigh wave."""
    w, k, a = 2 * np.pi * f, 2 * np.pi * f / c, np.zeros((6, 6), complex)

    def waves(i, z, sign):
        p, s, m, lam = *(sign * np.sqrt(k * k - (w / x[i]) ** 2 + 0j) for x in (vp, vs)), vs[i] ** 2, vp[i] ** 2 - 2 * vs[i] ** 2
        yield np.exp(p * z) * np.array([1j * k, p, 2j * m * k * p, (lam + 2 * m) * p * p - lam * k * k])
        yield np.exp(s * z) * np.array([-s, 1j * k, -m * (s * s + k * k), 2j * m * k * s])

    for j, (top, bottom) in enumerate(zip([*waves(0, 0, 1), *waves(0, 0, -1)], [*waves(0, h, 1), *waves(0, h, -1)], strict=True)):
        a[:2, j], a[2:, j] = top[2:], bottom
    a[2:, 4], a[2:, 5] = (-x for x in waves(1, h, -1))
    a /= np.abs(a).max(1, keepdims=True)
    return np.linalg.svd(a / np.abs(a).max(0, keepdims=True), compute_uv=False)[-1]


def test_rayleigh_waves():
    f = np.array([1.0, 3.0, 5.0, 7.0, 9.0, 40.0])
    same = inversion.rayleigh_wave_velocity([[10, 20]], [[200] * 3], [[400] * 3], f)
    assert np.allclose(same, 186.505181, atol=1e-5)  # the root of Rayleigh's cubic for vp = 2 vs
    c = inversion.rayleigh_wave_velocity([[10]], [[150, 400]], [[300, 800]], f)[0]
    assert (np.diff(c) < 0).all() and c[-1] == pytest.approx(150 * 186.505181 / 200, rel=1e-3)
    for a, b in zip(f[:5], c, strict=False):
        assert boundary_gap(b, a, 10, (150, 400), (300, 800)) < 1e-8 < 1e-4 < min(boundary_gap(b * x, a, 10, (150, 400), (300, 800)) for x in (0.98, 1.02))


def test_inversion_of_rayleigh_waves(spark):
    f = np.array([2.0, 4.0, 7.0, 12.0, 20.0])
    c = inversion.rayleigh_wave_velocity([[12.0]], [[200, 450]], [[400, 900]], f)[0]
    curve = spark.createDataFrame([(0, float(a), float(b)) for a, b in zip(f, c, strict=True)], "station int, f double, v double")
    got = inversion.invert(curve, [(5, 20, 100, 300, 0.32, 0.34), (0, 0, 300, 700, 0.32, 0.34)], runs=2, particles=20, steps=60, wave="rayleigh").toPandas()
    best = got[got["misfit"] == got["misfit"].min()].sort_values("layer")
    assert best["misfit"].iloc[0] < 2 and best["vs"].iloc[0] == pytest.approx(200, abs=10) and best["vs"].iloc[1] == pytest.approx(450, abs=25)
    assert got["poisson"].between(0.32, 0.34).all() and len(got) == 2 * 2 * (20 + 60 * 10)
    layers = spark.createDataFrame([(0, 0, 12.0, 200.0), (0, 1, 0.0, 450.0), (1, 0, 0.0, 300.0)], "model int, layer int, h double, vs double")
    s = {(r.model, r.layer, r.f): r.s for r in inversion.sensitivity(layers, [2.0, 40.0], keys=("model",), wave="rayleigh").collect()}
    assert len(s) == 6 and s[0, 0, 40.0] > 0.8 > s[0, 0, 2.0] and s[0, 1, 2.0] > s[0, 1, 40.0]


def test_sensitivities_of_many_models(spark, rng):
    """Thin, thick and sharply contrasted layers, all searched on the same grids, and models worked on together."""
    f, rows, want = np.array([2.0, 8.0, 40.0]), [], {}
    for m in range(60):
        n = m % 5 + 1
        h, vs = rng.uniform(1, 50, n), rng.uniform(100, [600, 60000, 9000][m % 3], n)
        rows += [(m, i, float(h[i]), float(vs[i])) for i in range(n)]
        for i in range(n):
            up, down = (np.where(np.arange(n) == i, vs * (1 + e), vs) for e in (0.01, -0.01))
            c = []
            for v in (up, down):
                value = lambda c, v=v: inversion._rayleigh_function(c[None], 2 * np.pi * f[:, None], h[None, :-1], v[None], 2 * vs[None])[0]
                low, high = np.full(3, 0.7 * v.min()), np.full(3, v[-1] * 0.999999)
                c.append(np.where(low < high, inversion._first_zero(value, *inversion._cells(value, low, high, 160)), np.nan))
            want |= {(m, i, a): b for a, b in zip(f, (c[0] - c[1]) / (0.02 * vs[i]), strict=True)}
    models = spark.createDataFrame(rows, "model int, layer int, h double, vs double")
    got = inversion.sensitivity(models, f.tolist(), keys=("model",), wave="rayleigh")
    found = {(r.model, r.layer, r.f): np.nan if r.s is None else r.s for r in got.collect()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9, nan_ok=True) for k in want)
    assert 0 < np.isfinite(list(want.values())).sum() < len(want)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()


def test_stiff_layers_cut_in_two(rng):
    """Whatever the contrast, layers cut in two, or given none of no thickness, have the same velocities."""
    f, n = np.array([2.0, 4.0, 8.0]), 200
    h, vs = rng.uniform(1, 50, (n, 4)), rng.uniform(900, 105000, (n, 5))
    vs[:, -1] = rng.uniform(900, 20000, n)
    c = inversion.rayleigh_wave_velocity(h, vs, 2 * vs, f)
    cut = np.repeat(vs, 2, 1)[:, :-1]
    assert 100 < np.isfinite(c).sum() < c.size
    assert np.allclose(inversion.rayleigh_wave_velocity(np.repeat(h / 2, 2, 1), cut, 2 * cut, f), c, rtol=1e-11, atol=0, equal_nan=True)
    more, none = np.insert(vs, 0, np.inf, 1), np.insert(h, 0, 0.0, 1)
    assert np.allclose(inversion.rayleigh_wave_velocity(none, more, 2 * more, f), c, rtol=1e-12, atol=0, equal_nan=True)


def test_work_of_a_curve_point(rng, monkeypatch):
    """A velocity costs few evaluations, and the modes counted are those of the whole grid."""
    seen, minors = [0], inversion._minors
    monkeypatch.setattr(inversion, "_minors", lambda c, *x: seen.__setitem__(0, seen[0] + len(c)) or minors(c, *x))
    f, n = np.array([2.0, 4.0, 8.0]), 500
    h, vs = rng.uniform(1, 50, (n, 3)), rng.uniform(900, 105000, (n, 4))
    c, slopes = inversion._rayleigh(h, vs, 2 * vs, f)
    assert seen[0] < 20 * c.size
    seen[0], changed = 0, vs * [1.01, 1, 1, 1]
    again = inversion._rayleigh(h, changed, 2 * vs, f, near=(c, slopes))[0]
    assert seen[0] < 12 * c.size
    assert np.allclose(again, inversion.rayleigh_wave_velocity(h, changed, 2 * vs, f), rtol=1e-12, atol=0, equal_nan=True)
    slow = rng.uniform(300, 3000, (n, 3))
    vs = np.insert(slow, 3, rng.uniform(3000, 30000, n), 1)
    h = rng.uniform(0.1, 0.9, (n, 3)) * slow / (2 * np.pi * f[2])
    these = (np.full(n, 2 * np.pi * f[2]), h.T, 1 / vs.T**2, 1 / (2 * vs.T) ** 2)
    one = inversion._one_mode(vs[:, -1] * 0.999999, *these)
    grid = inversion._function_of(these)[0](0.7 * vs.min(1)[:, None] + (vs[:, -1] * 0.999999 - 0.7 * vs.min(1))[:, None] * np.linspace(0, 1, 641))
    turns = (np.signbit(grid[:, 1:]) != np.signbit(grid[:, :-1])).sum(1)
    assert n // 10 < one.sum() < n and (turns[one] <= 1).all() and (turns[~one] > 1).mean() > 0.9


def test_registered_inversion_and_sensitivity(spark, monkeypatch):
    """The search has the reference's size, and the kernels are of every model of the table."""
    asked = {}
    monkeypatch.setattr(catalogue.inversion, "invert", lambda curves, bounds, **by: asked.update(by, layers=len(bounds)) or curves.withColumns({"run": F.lit(0), "model": F.lit(0)}))
    monkeypatch.setattr(catalogue, "rounded", lambda df, *a: df)
    monkeypatch.setattr(catalogue.inversion, "best_share", lambda df, *a: df)
    monkeypatch.setattr(catalogue.inversion, "mean_model", lambda df, **by: df)
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables here")
    catalogue.QUERIES["invert_curves"](spark, "/root/testdata/sf0.001")
    assert asked == {"runs": 5, "particles": 20, "steps": 1500, "layers": 5, "wave": "rayleigh"}
    layers = catalogue.models_of(spark, "/root/testdata/sf0.001")
    assert catalogue.QUERIES["sensitivity"](spark, "/root/testdata/sf0.001").select("model").distinct().count() == layers.select("model").distinct().count()


def test_diagnostics(spark, rng):
    x = rng.standard_normal((4, 64))
    df = frame(spark, x)
    assert diagnostics.common_clip(traces.samples(df), 0.5, ["gather", "ch"], ["gather"]).first().clip == pytest.approx(np.median([np.percentile(np.abs(r), 50) for r in x]))
    points = spark.createDataFrame([(0, float(a), float(b), 2.0 * a - b) for a in range(4) for b in range(4) if (a + b) % 2 == 0], "line int, x double, z double, v double")
    got = [r for r in diagnostics.interpolated_section(points, 7, 7).collect() if r.v is not None]
    assert len(got) > 25 and max(abs(r.v - (2 * r.x - r.z)) for r in got) < 1e-9
    assert diagnostics.spectrogram(traces.samples(df), 64.0, 16).count() == 4 * 9


def test_names_and_config(spark, tmp_path):
    rows = [("20230314_150926_field_cc_017_v1.npy",), ("20230316_cc_208_7d_v1_2M.npy",), ("20230317_235958_x_auto_v1_2M.npy",), ("garbage.npy",), ("20231399_cc_001_v1.npy",)]
    name = F.col("name")
    got = spark.createDataFrame(rows, "name string").select(names.stamp(name).alias("t"), names.source(name).alias("s"), names.method(name).alias("m"), names.window(name).alias("w")).collect()
    assert [tuple(r) for r in got[:3]] == [(datetime(2023, 3, 14, 15, 9, 26), 17, "v1", None), (datetime(2023, 3, 16), 208, "v1_2M", "7d"), (datetime(2023, 3, 17, 23, 59, 58), -1, "v1_2M", None)]
    assert got[3].t is None and got[3].s is None and got[4].t is None
    with pytest.raises(Exception, match="not a recording"):
        spark.createDataFrame(rows, "name string").select(names.strict(names.source(name), name)).collect()
    (tmp_path / "c.yaml").write_text("data: {first_chan: 1, last_chan: 5}\npreprocess: {decimation: 2}\n")
    with pytest.warns(UserWarning):
        s = config.correlation_settings(config.load(str(tmp_path / "c.yaml")))
    assert s["decimation"] == 2 and s["src_stride"] == 10 and s["preprocess"] == "exact"
    for bad in ({}, {"data": {"first_chan": 0, "last_chan": 1}, "xcorr": {"mode": "x"}}):
        with pytest.raises((KeyError, ValueError)):
            config.correlation_settings(bad)
    with pytest.raises(ValueError):
        config.preprocess_mode("other")
