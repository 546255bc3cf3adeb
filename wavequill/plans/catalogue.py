"""The registered queries of the operators: each on a whole table in a recording's role, with its DuckDB SQL where there is one.

Values are rounded to the digits that both engines agree on.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import names
from ..functions import arrays
from ..operators import correlate, delays, diagnostics, fidelity, gathers, imaging, inversion, stacking, traces
from ..sources import sinks
from . import planner
from .adapters import FS, SOURCE, panel, picks, stream, table
from .adapters import gathers as gather_of
from .adapters import models as models_of

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

P = "p AS (SELECT label AS gather, vec_id AS ch, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings)"
S = P + ", s AS (SELECT gather, ch, r, CAST(unnest(range(64)) AS INTEGER) AS i, unnest(e) AS x FROM p)"
G = P + f", g AS (SELECT gather, {SOURCE} AS vs, ch, CAST(r - {SOURCE} AS DOUBLE) AS o, CAST(unnest(range(63)) AS INTEGER) - 31 AS lag, unnest(e[1:63]) AS x FROM p)"
E = "e AS (SELECT event_type AS vs, user_id % 16 AS ch, user_id AS usr, ts, value AS x FROM events)"
K = "k AS (SELECT o_custkey % 20 AS dist, o_orderkey % 97 / 10.0::DOUBLE + 0.1::DOUBLE AS f, o_totalprice / 1000 + 100 AS v, o_orderstatus AS state FROM orders)"
M = "m AS (SELECT l_orderkey % 5 AS station, l_orderkey AS model, CAST(l_linenumber AS BIGINT) AS layer, min(l_quantity) AS h, min(l_extendedprice) AS vs, (l_orderkey * 7919 % 10007) / 100.0::DOUBLE AS misfit FROM lineitem GROUP BY ALL)"


def dft(source: str, value: str = "x", n: int = 64, keys: str = "gather, ch, r", i: str = "i", alias: str = "d") -> str:
    """A CTE of the real transform's bins k, re, im."""
    a = f"2 * pi() * k * {i} / {n}"
    return f"{alias} AS (SELECT {keys}, k, sum({value} * cos({a})) AS re, -sum({value} * sin({a})) AS im FROM {source}, (SELECT unnest(range({n // 2 + 1})) AS k) GROUP BY {keys}, k)"


def idft(source: str, n: int = 64, keys: str = "gather, ch", alias: str = "b") -> str:
    a = f"2 * pi() * k * i / {n}"
    return f"{alias} AS (SELECT {keys}, CAST(i AS INTEGER) AS i, sum(CASE WHEN k IN (0, {n // 2}) THEN 1 ELSE 2 END * (re * cos({a}) - im * sin({a}))) / {n} AS x FROM {source}, (SELECT unnest(range({n})) AS i) GROUP BY {keys}, i)"


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, and no -0."""
    return df.select(*[(F.round(f.name, digits) + 0.0).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])


def mapped(spark, sf_dir, function, digits: int = 6) -> DataFrame:
    return rounded(traces.samples(panel(spark, sf_dir).withColumn("x", function(F.col("x")))), digits)


# Maps of traces

W = "(PARTITION BY gather, ch)"


@query(f"WITH {S} SELECT gather, ch, i, round(x - (regr_slope(x, i) OVER {W} * i + regr_intercept(x, i) OVER {W}), 6) + 0.0 AS x FROM s")
def detrend(spark, sf):
    return mapped(spark, sf, arrays.detrend)


@query(f"WITH {S} SELECT gather, ch, i, round(x - avg(x) OVER {W}, 6) + 0.0 AS x FROM s")
def dc_remove(spark, sf):
    return mapped(spark, sf, arrays.demean)


@query(f"WITH {S}, l AS (SELECT *, lag(x) OVER w AS a, lead(x) OVER w AS b FROM s WINDOW w AS (PARTITION BY gather, ch ORDER BY i)) SELECT gather, ch, i, round(64 * CASE WHEN a IS NULL THEN b - x WHEN b IS NULL THEN x - a ELSE (b - a) / 2 END, 6) + 0.0 AS x FROM l")
def gradient(spark, sf):
    return mapped(spark, sf, lambda x: arrays.gradient(x, FS))


@query(f"WITH {S} SELECT gather, ch, i, round(x - median(x) OVER (PARTITION BY gather, i), 6) + 0.0 AS x FROM s")
def median_remove(spark, sf):
    return rounded(traces.subtract_median(panel(spark, sf)))


@query(f"WITH {S} SELECT gather, ch, i, CAST(sign(x) AS DOUBLE) + 0.0 AS x FROM s")
def onebit(spark, sf):
    return mapped(spark, sf, arrays.one_bit)


@query(f"WITH {S}, c AS (SELECT *, (sum(abs(x)) OVER (PARTITION BY gather, ch ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) + greatest(0, 2 - i) * abs(first_value(x) OVER (PARTITION BY gather, ch ORDER BY i)) + greatest(0, i - 61) * abs(first_value(x) OVER (PARTITION BY gather, ch ORDER BY i DESC))) / 5 AS a FROM s) SELECT gather, ch, i, round(x / a, 6) + 0.0 AS x FROM c")
def ram_norm(spark, sf):
    return mapped(spark, sf, lambda x: arrays.running_absolute_mean(x, 5))


@query(f"WITH {S} SELECT gather, ch, i, round(x / max(abs(x)) OVER {W}, 6) + 0.0 AS x FROM s")
def peak_norm(spark, sf):
    return mapped(spark, sf, arrays.normalise)


@query(f"WITH {S} SELECT gather, ch, i, round((x - avg(x) OVER {W}) / (stddev_samp(x) OVER {W} + 1e-12), 6) + 0.0 AS x FROM s")
def zscore(spark, sf):
    return mapped(spark, sf, arrays.z_score)


@query(f"WITH {S} SELECT gather, ch, i, round(avg(x) OVER (PARTITION BY gather, i ORDER BY ch ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) + 0.0 AS x FROM s")
def spatial_mean(spark, sf):
    return rounded(traces.spatial_mean(panel(spark, sf), 5).select("gather", "ch", "i", "x"))


def tukey_at(i: str, n: str, alpha: float) -> str:
    """The taper's weight where n is a column too."""
    near, edge = f"least({i}, {n} - 1 - {i})", f"({alpha!r}::DOUBLE * ({n} - 1) / 2)"
    return f"CASE WHEN {near} < {edge} THEN 0.5 * (1 + cos(pi() * ({near} / {edge} - 1))) ELSE 1 END"


def tukey_sql(i: str, n: int, alpha: float) -> str:
    near = f"least({i}, {n - 1} - {i})"
    edge = alpha * (n - 1) / 2
    return f"CASE WHEN {near} < {edge!r} THEN 0.5 * (1 + cos(pi() * ({near} / {edge!r}::DOUBLE - 1))) ELSE 1 END"


@query(f"WITH {S} SELECT gather, ch, i, round(x * {tukey_sql('i', 64, 0.1)}, 6) + 0.0 AS x FROM s")
def tukey_taper(spark, sf):
    return mapped(spark, sf, lambda x: arrays.taper(x, 0.1))


@query(f"WITH {S} SELECT gather, ch, CAST(i // 16 AS INTEGER) AS seg, CAST(i % 16 AS INTEGER) AS i, round(x, 6) + 0.0 AS x FROM s")
def segment(spark, sf):
    cut = traces.segments(panel(spark, sf), 16)
    return rounded(traces.samples(cut, keys=("gather", "ch", "seg")))


@query(f"WITH {S}, {dft('s')} SELECT gather, ch, CAST(k AS INTEGER) AS k, round(sqrt(re * re + im * im), 4) + 0.0 AS a FROM d")
def spectrum_mag(spark, sf):
    return rounded(panel(spark, sf).select("gather", "ch", F.posexplode(traces.amplitude("x")).alias("k", "a")), 4)


_A, _B = (f"{math.tan(math.pi * f / FS)!r}::DOUBLE" for f in (4, 16))
_MASK = f"CASE WHEN k IN (0, 32) THEN 0 ELSE 1 / (1 + pow((pow(tan(pi() * k / 64), 2) - {_A} * {_B}) / (tan(pi() * k / 64) * ({_B} - {_A})), 8)) END"


@query(f"WITH {S}, t AS (SELECT gather, ch, r, i, x * {tukey_sql('i', 64, 0.05)} AS x FROM s), {dft('t')}, m AS (SELECT gather, ch, k, re * {_MASK} AS re, im * {_MASK} AS im FROM d), {idft('m')} SELECT gather, ch, i, round(x, 4) + 0.0 AS x FROM b")
def bandpass_mask(spark, sf):
    return rounded(traces.samples(panel(spark, sf).withColumn("x", traces.band("x", FS, 4.0, 16.0, exact=False))), 4)


def white_sql(n: int) -> str:
    """Amplitudes over their own magnitude, tapered out of 4 to 20 Hz."""
    a, b, bins = int(4 / (FS / n)), math.ceil(20 / (FS / n)), n // 2 + 1
    w = f"CASE WHEN k < {a} THEN pow(cos(pi() / 2 + pi() / 2 * k / {a - 1}), 2) WHEN k >= {b} THEN pow(cos(pi() - pi() / 2 * (k - {b}) / {bins - b - 1}), 2) ELSE 1 END"
    return f"{w} / greatest(sqrt(re * re + im * im), 1e-10)"


@query(f"WITH {S}, {dft('s')}, m AS (SELECT gather, ch, k, re * {white_sql(64)} AS re, im * {white_sql(64)} AS im FROM d), {idft('m')} SELECT gather, ch, i, round(x, 4) + 0.0 AS x FROM b")
def whiten(spark, sf):
    return rounded(traces.samples(panel(spark, sf).withColumn("x", traces.whitened("x", FS, 4.0, 20.0))), 4)


@query(f"WITH {S}, t AS (SELECT gather, ch, i // 32 AS seg, i % 32 AS i, x FROM s), {dft('t', n=32, keys='gather, ch, seg')}, m AS (SELECT gather, ch, seg, k, re * {white_sql(32)} AS re, im * {white_sql(32)} AS im FROM d), {idft('m', n=32, keys='gather, ch, seg')} SELECT gather, ch, CAST(seg AS INTEGER) AS seg, i, round(x, 4) + 0.0 AS x FROM b")
def whiten_segments(spark, sf):
    cut = traces.segments(panel(spark, sf), 32).withColumn("x", traces.whitened("x", FS, 4.0, 20.0))
    return rounded(traces.samples(cut, keys=("gather", "ch", "seg")), 4)


# Correlation

C = "c AS (SELECT gather, ch, r, i // 32 AS seg, i % 32 AS i, x FROM {source}), q AS (SELECT a.gather, a.ch AS vs, b.ch AS ch, CAST(b.i - a.i AS INTEGER) AS lag, sum(a.x * b.x) / 2 AS r FROM c a JOIN c b ON a.gather = b.gather AND a.seg = b.seg AND b.i BETWEEN a.i - 8 AND a.i + 8 WHERE a.r % 10 = 0 GROUP BY ALL)"
ONE_BIT = f"z AS (SELECT gather, ch, r, i, CAST(sign(x - (regr_slope(x, i) OVER {W} * i + regr_intercept(x, i) OVER {W})) AS DOUBLE) AS x FROM s)"


def cut_in_two(spark, sf, clean: bool) -> DataFrame:
    rows = panel(spark, sf)
    if clean:
        rows = rows.withColumn("x", arrays.one_bit(arrays.detrend("x")))
    return traces.segments(rows, 32, ("gather", "r", "ch"))


def lag_rows(df: DataFrame, digits: int = 6) -> DataFrame:
    flat = df.select("gather", "vs", "ch", F.posexplode("r").alias("i", "r"))
    return rounded(flat.select("gather", "vs", "ch", (F.col("i") - 8).alias("lag"), "r"), digits)


@query(f"WITH {S}, {ONE_BIT}, {C.format(source='z')} SELECT gather, vs, ch, lag, round(r, 6) + 0.0 AS r FROM q")
def xcorr_vs(spark, sf):
    """Detrended one-bit traces, every tenth a source, correlated with all of their gather."""
    return lag_rows(correlate.correlate_traces(cut_in_two(spark, sf, True), 10, 8))


@query(f"WITH {S}, {C.format(source='s')} SELECT gather, vs, ch, lag, round(r, 5) + 0.0 AS r FROM q")
def xcorr_block(spark, sf):
    return lag_rows(correlate.correlate_traces(cut_in_two(spark, sf, False), 10, 8, method="block"), 5)


@query(f"WITH {S}, {C.format(source='s')} SELECT gather, vs, ch, lag, round(r, 5) + 0.0 AS r FROM q")
def xcorr_conventional(spark, sf):
    return lag_rows(correlate.correlate_traces(cut_in_two(spark, sf, False), 10, 8, method="conventional"), 5)


@query(f"WITH {S}, {C.format(source='s')} SELECT gather, vs, ch, lag, round(r, 6) + 0.0 AS r FROM q")
def xcorr_relational(spark, sf):
    return rounded(correlate.pairs_by_lag(cut_in_two(spark, sf, False), 10, 8))


@query(f"WITH {S}, {C.format(source='s')}, b AS (SELECT *, row_number() OVER (PARTITION BY gather, vs, ch ORDER BY r DESC, lag) AS n FROM q) SELECT gather, vs, ch, lag, round(r, 5) + 0.0 AS r FROM b WHERE n = 1")
def xcorr_peak(spark, sf):
    return rounded(correlate.peak_pairs(cut_in_two(spark, sf, False), 10, 8), 5)


@query(f"WITH {S}, c AS (SELECT gather, ch, i // 32 AS seg, i % 32 AS i, x FROM s) SELECT a.gather, a.ch, CAST(b.i - a.i AS INTEGER) AS lag, round(sum(a.x * b.x) / 2, 6) + 0.0 AS r FROM c a JOIN c b ON a.gather = b.gather AND a.ch = b.ch AND a.seg = b.seg AND b.i BETWEEN a.i - 8 AND a.i + 8 GROUP BY ALL")
def autocorr(spark, sf):
    return rounded(correlate.auto_correlate(cut_in_two(spark, sf, False), 8))


# Stacks


def _base(label: str, interval: str):
    sql = f"WITH {E} SELECT vs, ch, time_bucket(INTERVAL '{interval}', ts, TIMESTAMP '1970-01-01') AS w, round(avg(x), 6) + 0.0 AS x, count(x) AS n FROM e GROUP BY ALL"

    def run(spark, sf):
        out = stacking.base_stack(stream(spark, sf), label, ["vs", "ch"])
        return rounded(out.select("vs", "ch", F.col("end").cast("timestamp_ntz").alias("w"), "x", "n"))

    query(sql, f"stack_base_{label}")(run)


for _label, _interval in (("1h", "1 hour"), ("1d", "1 day"), ("2d", "2 days")):
    _base(_label, _interval)


@query()
def ncf_pipeline(spark, sf):
    """From whole panels to correlations: window of channels, preprocessing, whitening, segments, sources with receivers."""
    rows = panel(spark, sf).groupBy("gather").agg(F.array_sort(F.collect_list(F.struct("r", "x"))).alias("t"))
    panels = rows.select(F.concat(F.lit("p"), "gather").alias("file"), F.timestamp_seconds(F.lit(1_704_067_200) + F.col("gather") * 60).alias("t0"), F.lit(FS).alias("fs"), F.size("t").alias("nch"), F.flatten(F.transform("t", lambda p: p["x"])).cast("array<float>").alias("x"))
    config = {"data": {"fs_raw": FS, "first_chan": 0, "last_chan": 39, "src_stride": 10, "min_length_sec": 1}, "preprocess": {"f1": 4.0, "f2": 20.0, "mode": "spectral"}, "xcorr": {"max_lag_sec": 0.125, "xcorr_seg_sec": 0.5}}
    flat = correlate.correlate_panels(panels, config).select("file", F.col("t0").cast("timestamp_ntz").alias("t0"), "vs", "ch", F.posexplode("r").alias("i", "r"))
    return flat.select("file", "t0", "vs", "ch", (F.col("i") - 8).alias("lag"), (F.round(F.col("r").cast("double"), 4) + 0.0).alias("r"))


@query(f"WITH {G}, s AS (SELECT gather, vs, ch, abs(o) AS o, CASE WHEN o > 0 THEN 'right' ELSE 'left' END AS side, lag + 31 AS i, x FROM g WHERE o <> 0), {dft('s', n=63, keys='gather, vs, side, ch, o')}, "
       "a AS (SELECT gather, vs, side, o, k * 64 / 63.0::DOUBLE AS f, sum(sqrt(re * re + im * im)) OVER (PARTITION BY gather, vs, side, o ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS a FROM d), "
       "j AS (SELECT a.gather, a.vs, a.side, ln((b.a + 1e-15) / (a.a + 1e-15)) AS y, pi() * (a.o - b.o) * a.f / 100 AS t FROM a JOIN a b ON a.gather = b.gather AND a.side = b.side AND a.f = b.f AND b.o = 1 WHERE a.f BETWEEN 2 AND 20), "
       "n AS (SELECT gather, side, count(DISTINCT ch) AS n FROM s GROUP BY ALL) "
       "SELECT gather, vs, side, n, round(regr_slope(y, t), 6) + 0.0 AS slope, round(CASE WHEN regr_slope(y, t) > 0 THEN 1 / regr_slope(y, t) END, 3) + 0.0 AS q, round(regr_r2(y, t), 6) + 0.0 AS r2 FROM j JOIN n USING (gather, side) WHERE n >= 6 GROUP BY gather, vs, side, n")  # fmt: skip
def attenuation_sides(spark, sf):
    out = delays.attenuation_by_side(gather_of(spark, sf), FS, 100.0, 5, 2.0, 20.0)
    return out.select("gather", "vs", "side", "n", (F.round("slope", 6) + 0.0).alias("slope"), (F.round("q", 3) + 0.0).alias("q"), (F.round("r2", 6) + 0.0).alias("r2"))


def _rolling(name: str, label: str, days: int, keys: list[str], min_frac: float, by_steps: bool = False):
    cols = ", ".join(keys)
    need = max(1, math.ceil(days * min_frac))
    sql = f"WITH {E}, d AS (SELECT {cols}, date_trunc('day', ts) AS w, avg(x) AS x FROM e GROUP BY ALL), v AS (SELECT {cols}, w, avg(x) OVER o AS x, count(x) OVER o AS n FROM d WINDOW o AS (PARTITION BY {cols} ORDER BY w RANGE BETWEEN INTERVAL {days - 1} DAYS PRECEDING AND CURRENT ROW)) SELECT {cols}, CAST(w AS TIMESTAMP) AS w, round(x, 6) + 0.0 AS x, n FROM v WHERE n >= {need}"

    def run(spark, sf):
        rows = stream(spark, sf).withColumnRenamed("user", "usr")
        base = stacking.base_stack(rows, "1d", keys)
        roll = stacking.rolling_stack_by_steps if by_steps else stacking.rolling_stack
        return rounded(roll(base, label, keys, min_frac).select(*keys, F.col("end").cast("timestamp_ntz").alias("w"), "x", "n"))

    query(sql, name)(run)


_rolling("stack_roll_7d", "7d", 7, ["vs"], 0.9)
_rolling("stack_roll_15d", "15d", 15, ["vs"], 0.9)
_rolling("stack_roll_gappy", "7d", 7, ["vs", "usr"], 0.4)
_rolling("stack_roll_steps", "7d", 7, ["vs", "usr"], 0.4, by_steps=True)


@query(f"WITH {E}, d AS (SELECT vs, ch, date_trunc('day', ts) AS w, avg(x) AS x FROM e GROUP BY ALL) SELECT vs, ch, CAST(w AS TIMESTAMP) AS w, round(x, 6) + 0.0 AS x, round(avg(x) OVER (PARTITION BY vs, ch), 6) + 0.0 AS ref FROM d")
def ref_stack(spark, sf):
    base = stacking.base_stack(stream(spark, sf), "1d", ["vs", "ch"])
    return rounded(stacking.reference(base, ["vs", "ch"]).select("vs", "ch", F.col("end").cast("timestamp_ntz").alias("w"), "x", "ref"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)")
def resume_antijoin(spark, sf):
    wanted = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    done = table(spark, sf, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    return sinks.pending(wanted, done, ["o_orderkey"])


A = "a AS (SELECT gather AS vs, ch % 20 AS d, i, avg(x) AS x, count(*) AS n FROM s GROUP BY ALL)"


def daily_arrays(spark, sf) -> DataFrame:
    """vs, t0, r: traces as correlations of twenty days, some a day."""
    when = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("ch") % 20 * 86_400 + F.col("ch") % 24 * 3600)
    return panel(spark, sf).select(F.col("gather").alias("vs"), when.alias("t0"), F.col("x").alias("r"))


def day_rows(df: DataFrame, columns: list[str], value: str = "r") -> DataFrame:
    flat = df.select(*columns, F.col("end").cast("timestamp_ntz").alias("w"), F.posexplode(value).alias("i", "x"))
    return rounded(flat)


@query(f"""WITH {S}, {A}, r AS (SELECT vs, d, i, avg(x) AS x, count(*) AS n FROM (SELECT k.vs, k.d, a.i, a.x FROM (SELECT DISTINCT vs, d FROM a) k JOIN a ON k.vs = a.vs AND a.d BETWEEN k.d - 6 AND k.d) GROUP BY vs, d, i)
SELECT z AS "window", vs, TIMESTAMP '2024-01-01' + to_days(CAST(d AS INTEGER)) AS w, i, round(x, 6) + 0.0 AS x, n FROM (SELECT '1d' AS z, * FROM a UNION ALL SELECT '7d', * FROM r WHERE n >= 5)""")
def stack_arrays(spark, sf):
    """Daily stacks of whole correlations, and those of seven days of which five are there."""
    config = {"stacking": {"base_stack": "1d", "min_frac": 0.7, "windows": {"7d": True}}}
    return day_rows(stacking.run_plan(daily_arrays(spark, sf), config, ["vs"]), ["window", "vs", "n"])


@query(f"""WITH {S}, {A} SELECT vs, TIMESTAMP '2024-01-01' + to_days(CAST(d AS INTEGER)) AS w, i, round(x, 6) + 0.0 AS x, round(avg(x) OVER (PARTITION BY vs, i), 6) + 0.0 AS ref FROM a""")
def ref_stack_arrays(spark, sf):
    base = stacking.base_stack_arrays(daily_arrays(spark, sf), "1d", ["vs"])
    both = stacking.reference_arrays(base, ["vs"])
    flat = both.select("vs", F.col("end").cast("timestamp_ntz").alias("w"), F.posexplode(F.arrays_zip("r", "ref")).alias("i", "p"))
    return rounded(flat.select("vs", "w", "i", F.col("p.r").alias("x"), F.col("p.ref").alias("ref")))


# Gathers


def gather_rows(df: DataFrame, first_lag: int, digits: int = 6) -> DataFrame:
    flat = df.select("gather", "ch", "offset", F.posexplode("r").alias("i", "x"))
    return rounded(flat.select("gather", "ch", "offset", (F.col("i") + first_lag).alias("lag"), "x"), digits)


GO = "SELECT gather, ch, o AS \"offset\", {lag} AS lag, round({x}, 6) + 0.0 AS x FROM g"


@query(f"WITH {G} SELECT gather, ch, abs(lag) AS lag, CASE WHEN part THEN 'causal' ELSE 'acausal' END AS side, round(x, 6) + 0.0 AS x FROM (SELECT *, true AS part FROM g WHERE lag >= 0 UNION ALL SELECT *, false FROM g WHERE lag <= 0)")
def causal_acausal(spark, sf):
    g = gather_of(spark, sf)
    both = g.select("gather", "ch", F.lit("causal").alias("side"), F.posexplode(arrays.causal("r")).alias("lag", "x")).unionByName(g.select("gather", "ch", F.lit("acausal").alias("side"), F.posexplode(arrays.acausal("r")).alias("lag", "x")))
    return rounded(both)


@query(f"WITH {G} {GO.format(lag='abs(lag)', x='x')} WHERE (o < 0 AND lag >= 0) OR (o >= 0 AND lag <= 0)")
def s1_section(spark, sf):
    return gather_rows(gathers.sided(gather_of(spark, sf), "S1"), 0)


@query(f"WITH {G} {GO.format(lag='abs(lag)', x='x')} WHERE (o < 0 AND lag <= 0) OR (o >= 0 AND lag >= 0)")
def s2_section(spark, sf):
    return gather_rows(gathers.sided(gather_of(spark, sf), "S2"), 0)


@query(f"WITH {G} {GO.format(lag='lag', x='x')} WHERE o BETWEEN 2 AND 20")
def clip_side(spark, sf):
    return gather_rows(gathers.clip_side(gather_of(spark, sf), "right", 2.0, 20.0), -31)


@query(f"WITH {G} {GO.format(lag='lag', x='x * CASE WHEN abs(o) <= 5 THEN 0 WHEN abs(o) < 15 THEN 0.5 * (1 - cos(pi() * (abs(o) - 5) / 10)) ELSE 1 END')}")
def inner_mute(spark, sf):
    return gather_rows(gathers.inner_mute(gather_of(spark, sf), 5.0, 10.0), -31)


@query(f"WITH {G} {GO.format(lag='lag', x='CASE WHEN abs(lag) / 64.0::DOUBLE BETWEEN greatest(0, greatest(0, abs(o) - 2) / 100 - 0.05::DOUBLE) AND abs(o) / 50 + 0.1::DOUBLE THEN x ELSE 0 END')}")
def cone_mute(spark, sf):
    return gather_rows(gathers.cone_mute(gather_of(spark, sf), 1 / FS, 50.0, 100.0, 2.0, 0.05, 0.1, centred=True), -31)


@query(f"WITH {G}, n AS (SELECT *, dense_rank() OVER (PARTITION BY gather ORDER BY ch) - 1 AS j, count(*) OVER (PARTITION BY gather) / 63 AS n FROM g) SELECT gather, ch, o AS \"offset\", lag, round(x * CASE WHEN least(j, n - 1 - j) < 0.1::DOUBLE * (n - 1) / 2 THEN 0.5 * (1 + cos(pi() * (least(j, n - 1 - j) / (0.1::DOUBLE * (n - 1) / 2) - 1))) ELSE 1 END, 6) + 0.0 AS x FROM n")
def spatial_taper(spark, sf):
    return gather_rows(gathers.spatial_taper(gather_of(spark, sf), 0.1), -31)


@query(f"WITH {G}, s AS (SELECT DISTINCT gather, vs, ch, o, CASE WHEN o > 0 THEN 'right' ELSE 'left' END AS side FROM g WHERE o <> 0), n AS (SELECT *, count(*) OVER (PARTITION BY gather, vs, side) AS n FROM s) SELECT gather, vs, ch, o AS \"offset\", side FROM n WHERE n > 5")
def side_split(spark, sf):
    return gathers.sides(gather_of(spark, sf)).select("gather", "vs", "ch", "offset", "side")


@query(f"WITH {G} SELECT gather, ch, abs(lag) AS lag, round(CASE WHEN lag = 0 THEN sum(x) ELSE sum(x) / 2 END, 6) + 0.0 AS x FROM (SELECT gather, ch, abs(lag) AS lag, x FROM g) GROUP BY gather, ch, lag")
def fold(spark, sf):
    return rounded(gather_of(spark, sf).select("gather", "ch", F.posexplode(arrays.fold("r")).alias("lag", "x")))


@query(f"""WITH {G}, c AS (SELECT gather, row_number() OVER (PARTITION BY gather, lag ORDER BY o, ch) - 1 AS j, count(*) OVER (PARTITION BY gather, lag) AS n, lag + 31 AS i, x FROM g),
a AS (SELECT gather, n, j, q, sum(x * cos(2 * pi() * q * i / 63)) AS re, -sum(x * sin(2 * pi() * q * i / 63)) AS im FROM c, (SELECT unnest(range(63)) AS q) GROUP BY ALL),
u AS (SELECT DISTINCT gather, n, unnest(range(n)) AS w FROM c),
b AS (SELECT a.gather, a.n, w, q, sum(re * cos(2 * pi() * w * j / a.n) + im * sin(2 * pi() * w * j / a.n)) AS re, sum(im * cos(2 * pi() * w * j / a.n) - re * sin(2 * pi() * w * j / a.n)) AS im FROM a JOIN u ON a.gather = u.gather GROUP BY ALL)
SELECT gather, CAST((w + n // 2) % n AS INTEGER) AS k, CAST((q + 31) % 63 AS INTEGER) AS f, round(sqrt(re * re + im * im), 4) + 0.0 AS p FROM b""")
def fk_power(spark, sf):
    return rounded(gathers.fk_power(gather_of(spark, sf), 1 / FS, 1.0).select("gather", "k", "f", "p"), 4)


# Images and curves

IMAGE = f"""{S}, {dft('s')}, h AS (SELECT gather, r, k, re / (sqrt(re * re + im * im) + 1e-8) AS re, im / (sqrt(re * re + im * im) + 1e-8) AS im FROM d WHERE k BETWEEN 2 AND 20),
t AS (SELECT gather, k, v, re, im, 2 * pi() * k * r / v AS a FROM h, (SELECT CAST(unnest(range(20, 201, 10)) AS DOUBLE) AS v)),
img AS (SELECT gather, CAST(k AS DOUBLE) AS f, v, sqrt(pow(sum(re * cos(a) - im * sin(a)), 2) + pow(sum(re * sin(a) + im * cos(a)), 2)) AS p FROM t GROUP BY gather, k, v)"""


def fv(spark, sf, normalise=False) -> DataFrame:
    rows = panel(spark, sf).select("gather", "ch", F.col("r").cast("double").alias("offset"), F.col("x").alias("r"))
    return imaging.image(rows, 1 / FS, 20.0, 200.0, 10.0, 2.0, 20.0, normalise, keys=("gather",))


@query(f"WITH {IMAGE} SELECT gather, f, v, round(p, 4) + 0.0 AS p FROM img")
def fv_panel(spark, sf):
    return rounded(fv(spark, sf), 4)


@query(f"WITH {IMAGE} SELECT gather, f, v, round(p / max(p) OVER (PARTITION BY gather, f), 4) + 0.0 AS p FROM img")
def fv_norm(spark, sf):
    return rounded(imaging.normalised(fv(spark, sf)), 4)


@query(f"WITH {IMAGE}, b AS (SELECT *, row_number() OVER (PARTITION BY gather, f ORDER BY p DESC, v) AS n FROM img) SELECT gather, f, v, round(p, 4) + 0.0 AS p FROM b WHERE n = 1")
def fv_argmax(spark, sf):
    return rounded(imaging.best(fv(spark, sf)), 4)


@query(f"WITH {IMAGE} SELECT gather, f, v, round(CASE WHEN v < 60 THEN 0 ELSE p END, 4) + 0.0 AS p FROM img WHERE f BETWEEN 4 AND 16")
def fv_muted_band(spark, sf):
    band = fv(spark, sf).where(F.col("f").between(4, 16))
    return rounded(band.withColumn("p", F.when(F.col("v") < 60, 0.0).otherwise(F.col("p"))), 4)


KNOTS = "SELECT dist, f AS f0, v AS v0, lead(f) OVER (PARTITION BY dist ORDER BY f) AS f1, lead(v) OVER (PARTITION BY dist ORDER BY f) AS v1 FROM "


@query(f"WITH {K}, a AS (SELECT dist, f, avg(v) AS v FROM k WHERE f BETWEEN 0.875 AND 9.125 GROUP BY ALL), n AS ({KNOTS} a), g AS (SELECT 1 + unnest(range(33)) * 0.25::DOUBLE AS g) SELECT dist, g AS f, round(CASE WHEN f1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (g - f0) / (f1 - f0) END, 6) + 0.0 AS v FROM n JOIN g ON g = f0 OR (g > f0 AND g < f1)")
def regularize(spark, sf):
    return rounded(imaging.regularise(picks(spark, sf).select("dist", "f", "v"), 1.0, 9.0, 0.25))


@query(f"WITH {K}, c AS (SELECT dist, f, avg(v) AS v FROM k WHERE state = 'O' GROUP BY ALL), r AS (SELECT dist, f, avg(v) AS v FROM k WHERE state = 'F' GROUP BY ALL), n AS ({KNOTS} c) SELECT r.dist, r.f, round((CASE WHEN f1 IS NULL OR r.f = f0 THEN v0 ELSE v0 + (v1 - v0) * (r.f - f0) / (f1 - f0) END - r.v) / r.v, 6) + 0.0 AS dvv FROM n JOIN r ON n.dist = r.dist AND (r.f = f0 OR (r.f > f0 AND r.f < f1))")
def dvv_curve(spark, sf):
    k = picks(spark, sf).groupBy("dist", "f", "state").agg(F.avg("v").alias("v"))
    return rounded(imaging.curve_change(k.where("state = 'O'").drop("state"), k.where("state = 'F'").drop("state"), ["dist"]))


@query(f"WITH {K} SELECT dist, round(f, 6) AS f, round(v / f * 0.333::DOUBLE, 4) + 0.0 AS z, count(*) AS n FROM k GROUP BY ALL")
def depth_map(spark, sf):
    rows = picks(spark, sf).select("dist", F.round("f", 6).alias("f"), F.round(imaging.depth("v", "f"), 4).alias("z"))
    return rows.groupBy("dist", "f", "z").agg(F.count("*").alias("n"))


# Changes, attenuation, delays


def with_reference(spark, sf) -> DataFrame:
    rows = panel(spark, sf)
    mean = traces.samples(rows).groupBy("gather", "i").agg(F.avg("x").alias("x"))
    ref = mean.groupBy("gather").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("ref"))
    return rows.select("gather", "ch", "r", "x").join(ref, "gather")


STRETCH = f"""{S}, f AS (SELECT gather, i, avg(x) AS x FROM s GROUP BY ALL), l AS (SELECT gather, list(x ORDER BY i) AS f FROM f GROUP BY gather),
y AS (SELECT s.gather, ch, i, x, n, -0.05::DOUBLE + n * (0.1::DOUBLE / 20) AS eps, f, i * (1 + (-0.05::DOUBLE + n * (0.1::DOUBLE / 20))) AS u FROM s JOIN l USING (gather), (SELECT unnest(range(21)) AS n)),
z AS (SELECT gather, ch, n, eps, x, CASE WHEN u BETWEEN 0 AND 63 THEN f[CAST(floor(u) AS INTEGER) + 1] + (u - floor(u)) * (f[least(CAST(floor(u) AS INTEGER) + 1, 63) + 1] - f[CAST(floor(u) AS INTEGER) + 1]) ELSE 0 END AS m FROM y),
c AS (SELECT gather, ch, n, eps, coalesce(sum(m * x) / nullif(sqrt(sum(m * m) * sum(x * x)), 0), 0) AS cc FROM z GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY gather, ch ORDER BY cc DESC, n) AS o FROM c)"""


@query(f"WITH {STRETCH} SELECT gather, ch, round(eps * 100, 6) + 0.0 AS eps, round(cc, 6) + 0.0 AS cc FROM b WHERE o = 1")
def stretch_dvv(spark, sf):
    return rounded(delays.stretch(with_reference(spark, sf).drop("r"), 0.05, 21))


@query(f"WITH {STRETCH}, q AS (SELECT gather, CASE WHEN cc >= 0.1 AND abs(eps * 100) <= 4 THEN eps * 100 END AS e FROM b WHERE o = 1) SELECT gather, round(avg(e), 6) + 0.0 AS dvv_mean, round(stddev_pop(e), 6) + 0.0 AS dvv_std, count(e) AS n_pairs FROM q GROUP BY gather")
def dvv_aggregate(spark, sf):
    return rounded(delays.aggregate(delays.stretch(with_reference(spark, sf).drop("r"), 0.05, 21), 0.1, 4.0, keys=("gather",)))


@query(f"""WITH {S}, f AS (SELECT gather, i, avg(x) AS x FROM s GROUP BY ALL),
c AS (SELECT s.gather, s.ch, s.r, f.i - s.i AS lag, sum(s.x * f.x) AS cc FROM s JOIN f ON s.gather = f.gather AND f.i - s.i BETWEEN -32 AND 31 WHERE s.r >= 1 GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY gather, ch ORDER BY cc DESC, lag) AS o FROM c)
SELECT gather, ch, CAST(lag AS INTEGER) AS lag, round(lag / 64.0::DOUBLE * 100 / r, 6) + 0.0 AS dvv, round(cc, 6) + 0.0 AS cc FROM b WHERE o = 1""")
def xcorr_dvv(spark, sf):
    rows = with_reference(spark, sf).withColumnRenamed("r", "offset")
    return rounded(delays.delay_changes(rows, 1 / FS, 100.0).select("gather", "ch", "lag", "dvv", "cc"))


@query(f"""WITH {S}, {dft('s')}, a AS (SELECT gather, r, k, sum(sqrt(re * re + im * im)) OVER (PARTITION BY gather, r ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS a FROM d),
j AS (SELECT a.gather, ln((b.a + 1e-15) / (a.a + 1e-15)) AS y, pi() * a.r * a.k / 100 AS t FROM a JOIN a b ON a.gather = b.gather AND a.k = b.k AND b.r = 0 WHERE a.k BETWEEN 2 AND 20),
q AS (SELECT gather, regr_slope(y, t) AS slope, regr_r2(y, t) AS r2 FROM j GROUP BY gather)
SELECT gather, round(slope, 6) + 0.0 AS slope, round(CASE WHEN slope > 0 THEN 1 / slope END, 3) + 0.0 AS q, round(r2, 6) + 0.0 AS r2 FROM q""")
def attenuation_q(spark, sf):
    rows = panel(spark, sf).select("gather", F.col("r").cast("double").alias("offset"), F.posexplode(traces.amplitude("x")).alias("k", "a"))
    spectra = rows.select("gather", "offset", F.col("k").cast("double").alias("f"), "a")
    out = delays.attenuation(spectra, 100.0, 5, 2.0, 20.0)
    return out.select("gather", (F.round("slope", 6) + 0.0).alias("slope"), (F.round("q", 3) + 0.0).alias("q"), (F.round("r2", 6) + 0.0).alias("r2"))


@query(f"""WITH {S}, z AS (SELECT gather, ch, i, (x - avg(x) OVER {W}) / (stddev_samp(x) OVER {W} + 1e-12) AS x FROM s), l AS (SELECT gather, ch, list(x ORDER BY i) AS x FROM z GROUP BY ALL),
y AS (SELECT a.gather, a.ch AS i, b.ch AS j, unnest(range(-63, 64)) AS lag, a.x AS x, b.x AS y FROM l a JOIN l b ON a.gather = b.gather AND a.ch < b.ch),
c AS (SELECT gather, i, j, lag, list_dot_product(x[greatest(1, 1 + lag):least(64, 64 + lag)], y[greatest(1, 1 - lag):least(64, 64 - lag)]) / 64 AS cc FROM y),
b AS (SELECT gather, i, j, max(cc) AS cc FROM c GROUP BY ALL)
SELECT gather, i, j, round(cc, 5) + 0.0 AS cc FROM b""")
def mccc_pairs(spark, sf):
    return rounded(delays.pair_lags(panel(spark, sf), 1 / FS).select("gather", "i", "j", "cc"), 5)


# Fidelity and benchmark figures


def coarse_pairs(spark, sf) -> DataFrame:
    """Traces beside the same to one digit."""
    rows = traces.samples(panel(spark, sf))
    return fidelity.paired(rows.withColumn("x", F.floor(F.col("x") * 10 + 0.5) / 10.0), rows, ["gather", "ch", "i"])


COARSE = f"{S}, t AS (SELECT gather, ch, floor(x * 10 + 0.5::DOUBLE) / 10 AS v, x AS r FROM s), c AS (SELECT gather, ch, CASE WHEN sqrt(sum(v * v)) < 1e-15 AND sqrt(sum(r * r)) < 1e-15 THEN 1 ELSE sum(v * r) / (sqrt(sum(v * v)) * sqrt(sum(r * r)) + 1e-15) END AS cosine, sum(r * r) AS rr, sum((v - r) * (v - r)) AS dd, max(abs(v - r)) AS max_abs FROM t GROUP BY ALL)"


@query(f"WITH {COARSE} SELECT gather, ch, round(cosine, 6) + 0.0 AS cosine FROM c")
def cosine_trace(spark, sf):
    return rounded(fidelity.per_trace(coarse_pairs(spark, sf), ["gather", "ch"]).select("gather", "ch", "cosine"))


FIDELITY = "SELECT gather, sqrt(sum(dd)) / (sqrt(sum(rr)) + 1e-15) AS rel_fro, max(max_abs) AS max_abs, avg(cosine) AS cos_mean, quantile_cont(cosine, 0.05) AS cos_p05 FROM c GROUP BY gather"


@query(f"WITH {COARSE}, q AS ({FIDELITY}) SELECT gather, round(rel_fro, 6) + 0.0 AS rel_fro, round(max_abs, 6) + 0.0 AS max_abs, round(cos_mean, 6) + 0.0 AS cos_mean, round(cos_p05, 6) + 0.0 AS cos_p05 FROM q", "fidelity")
def fidelity_query(spark, sf):
    return rounded(fidelity.summary(fidelity.per_trace(coarse_pairs(spark, sf), ["gather", "ch"]), ["gather"]))


@query(f"WITH {COARSE}, q AS ({FIDELITY}) SELECT CAST(gather % 2 AS INTEGER) AS grp, round(max(rel_fro), 6) + 0.0 AS rel_fro, round(max(max_abs), 6) + 0.0 AS max_abs, round(avg(cos_mean), 6) + 0.0 AS cos_mean, round(min(cos_p05), 6) + 0.0 AS cos_p05, count(*) AS n FROM q GROUP BY 1")
def fidelity_worst(spark, sf):
    s = fidelity.summary(fidelity.per_trace(coarse_pairs(spark, sf), ["gather", "ch"]), ["gather"]).withColumn("grp", F.col("gather") % 2)
    return rounded(fidelity.worst(s, ["grp"]))


@query(f"""WITH {S}, t AS (SELECT gather, ch, i, floor(x * 10 + 0.5::DOUBLE) / 10 AS v, x FROM s), {dft('t', 'v', keys='gather, ch', alias='dv')}, {dft('t', 'x', keys='gather, ch', alias='dr')},
j AS (SELECT gather, ch, a.k, a.re AS vre, a.im AS vim, b.re AS rre, b.im AS rim FROM dv a JOIN dr b USING (gather, ch, k))
SELECT gather, ch, round(sqrt(sum(CASE WHEN k BETWEEN 4 AND 20 THEN pow(vre - rre, 2) + pow(vim - rim, 2) ELSE 0 END)) / (sqrt(sum(CASE WHEN k BETWEEN 4 AND 20 THEN rre * rre + rim * rim ELSE 0 END)) + 1e-15), 5) + 0.0 AS error,
round(sqrt(sum(CASE WHEN k NOT BETWEEN 4 AND 20 THEN vre * vre + vim * vim ELSE 0 END)) / (sqrt(sum(CASE WHEN k BETWEEN 4 AND 20 THEN vre * vre + vim * vim ELSE 0 END)) + 1e-15), 5) + 0.0 AS leakage FROM j GROUP BY ALL""")
def spectral_compare(spark, sf):
    import numpy as np

    from ..functions.udfs import trace_map

    both = lambda c: (trace_map(lambda m: np.fft.rfft(m).real)(c), trace_map(lambda m: np.fft.rfft(m).imag)(c))
    rows = panel(spark, sf).select("gather", "ch", F.col("x").alias("r"), F.transform("x", lambda v: F.floor(v * 10 + 0.5) / 10.0).alias("v"))
    parts = rows.select("gather", "ch", *[c.alias(n) for n, c in zip(("vre", "vim", "rre", "rim"), (*both("v"), *both("r")), strict=True)])
    flat = parts.select("gather", "ch", F.posexplode(F.arrays_zip("vre", "vim", "rre", "rim")).alias("k", "s")).select("gather", "ch", F.col("k").cast("double").alias("f"), "s.*")
    return rounded(fidelity.spectral(flat, 4.0, 20.0, ["gather", "ch"]), 5)


@query(f"WITH {IMAGE}, q AS (SELECT gather, quantile_cont(abs(p), 0.995) AS t FROM img GROUP BY gather) SELECT gather, f, v, round(least(p, t) / t, 4) + 0.0 AS p FROM img JOIN q USING (gather)")
def clip_norm(spark, sf):
    return rounded(fidelity.clip_scaled(fv(spark, sf), ["gather"]), 4)


@query(f"WITH {K}, a AS (SELECT dist, f, avg(v) FILTER (state = 'O') AS v, avg(v) FILTER (state = 'F') AS r FROM k GROUP BY ALL), d AS (SELECT dist, abs(v - r) AS d, abs(v - r) / (abs(r) + 1e-15) AS e FROM a WHERE v IS NOT NULL AND r IS NOT NULL) SELECT dist, count(*) AS n, round(median(d), 6) AS median_abs, round(sqrt(avg(d * d)), 6) AS rms, round(quantile_cont(d, 0.95), 6) AS p95_abs, round(max(d), 6) AS max_abs, round(median(e), 6) AS median_rel, round(quantile_cont(e, 0.95), 6) AS p95_rel FROM d GROUP BY dist")
def pick_diff(spark, sf):
    of = lambda s: F.avg(F.when(F.col("state") == s, F.col("v")))
    return rounded(fidelity.pick_differences(picks(spark, sf).groupBy("dist", "f").agg(of("O").alias("v"), of("F").alias("r")), ["dist"]))


_RUNS = [(n, m, *planner.shape(n, m, method), method) for n in (2000, 15000) for m in (125, 500, 1000) for method in ("conventional", "block")]
_VALUES = ", ".join(f"({n}, {m}, {length}, {blocks}, '{method}')" for n, m, length, blocks, method in _RUNS)


@query(f"""WITH t AS (SELECT * FROM (VALUES {_VALUES}) AS t(npts, lags, len, blk, method)), j AS (SELECT npts, lags, len::BIGINT AS len, blk::BIGINT AS blk, method, 16::BIGINT AS n_vs, (100 + n_nationkey)::BIGINT AS nch, 10::BIGINT AS nseg FROM nation, t),
c AS (SELECT *, (n_vs * nseg * blk * (1 + nch) + n_vs * nch) * (2.5::DOUBLE * len * log2(len)) + n_vs * nch * nseg * blk * (len // 2 + 1) * 8.0::DOUBLE AS fl, ((n_vs * nseg * blk * (1 + nch) + n_vs * nch) * (len * 4 + (len // 2 + 1) * 8))::DOUBLE + n_vs * nch * nseg * blk * (len // 2 + 1) * 8.0::DOUBLE AS mb FROM j)
SELECT CAST(nch AS INTEGER) AS nch, npts, lags, method, round(fl / 1e6, 3) AS mflop, round(mb / 1e6, 3) AS mbytes, CAST(n_vs * nch AS BIGINT) AS n_corr, round(fl / mb, 6) AS intensity FROM c""")
def cost_model(spark, sf):
    plans = F.broadcast(spark.createDataFrame(_RUNS, "npts int, lags int, fft_length int, blocks int, method string"))
    runs = table(spark, sf, "nation").select((F.col("n_nationkey") + 100).cast("int").alias("nch"), F.lit(16).alias("n_vs"), F.lit(10).alias("nseg")).crossJoin(plans)
    out = planner.costs(runs)
    return out.select("nch", "npts", "lags", "method", F.round(F.col("flops") / 1e6, 3).alias("mflop"), F.round(F.col("bytes_moved") / 1e6, 3).alias("mbytes"), "n_corr", F.round("intensity", 6).alias("intensity"))


def cores_of(spark, sf) -> DataFrame:
    t = table(spark, sf, "lineitem")
    return t.groupBy((F.col("l_suppkey") % 10).alias("run"), F.col("l_linenumber").alias("cores")).agg((1e6 / F.avg("l_extendedprice") / F.col("l_linenumber")).alias("sec"))


CORES = "t AS (SELECT l_suppkey % 10 AS run, l_linenumber AS cores, 1e6::DOUBLE / avg(l_extendedprice) / any_value(l_linenumber) AS sec FROM lineitem GROUP BY 1, 2), u AS (SELECT *, first_value(sec) OVER (PARTITION BY run ORDER BY cores) / sec AS speedup FROM t)"


@query(f"WITH {CORES} SELECT run, cores, round(sec, 6) AS sec, round(speedup, 6) AS speedup, round(speedup / cores, 6) AS efficiency FROM u")
def scaling(spark, sf):
    return rounded(fidelity.scaling(cores_of(spark, sf), ["run"]))


@query(f"WITH {CORES} SELECT run, round(avg(least(greatest((1 / speedup - 1.0::DOUBLE / cores) / (1 - 1.0::DOUBLE / cores), 0), 1)), 6) + 0.0 AS serial FROM u WHERE cores > 1 GROUP BY run")
def amdahl(spark, sf):
    return rounded(fidelity.serial_fraction(fidelity.scaling(cores_of(spark, sf), ["run"]), ["run"]))


@query("WITH t AS (SELECT user_id AS usr, event_type AS kind, event_id AS rep, value AS sec, value * 2 AS mem, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events), k AS (SELECT * FROM t WHERE i > 1 OR n = 1) SELECT usr, kind, count(*) AS n, round(median(sec), 6) AS median, round(avg(sec), 6) AS mean, round(stddev_samp(sec), 6) AS std, round(quantile_cont(sec, 0.25), 6) AS p25, round(quantile_cont(sec, 0.75), 6) AS p75, round(quantile_cont(sec, 0.95), 6) AS p95, round(max(mem), 6) AS mem FROM k GROUP BY usr, kind")
def repeat_stats(spark, sf):
    runs = table(spark, sf, "events").select(F.col("user_id").alias("usr"), F.col("event_type").alias("kind"), F.col("event_id").alias("repeat"), F.col("value").alias("sec"), (F.col("value") * 2).alias("mem"))
    return rounded(fidelity.repeat_statistics(runs, ["usr", "kind"]))


# Models

TOP = f"{M}, i AS (SELECT DISTINCT station, model, misfit FROM m), o AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY misfit, model) AS n, count(*) OVER (PARTITION BY station) AS c FROM i), b AS (SELECT m.* FROM m JOIN o USING (station, model) WHERE o.n <= floor(o.c * 10 / 100) + 1)"


@query(f"WITH {TOP} SELECT station, model, layer, round(h, 6) AS h, round(vs, 6) AS vs, round(misfit, 6) AS misfit FROM b")
def top_percent(spark, sf):
    return rounded(inversion.best_share(models_of(spark, sf), 10.0).select("station", "model", "layer", "h", "vs", "misfit"))


@query(f"WITH {TOP} SELECT station, layer, round(avg(h), 6) AS h, round(avg(vs), 6) AS vs, count(*) AS n FROM b GROUP BY ALL")
def mean_model(spark, sf):
    return rounded(inversion.mean_model(inversion.best_share(models_of(spark, sf), 10.0)))


@query(f"WITH {M} SELECT station, layer, round(min(vs), 6) AS p0, round(quantile_cont(vs, 0.25), 6) AS p25, round(quantile_cont(vs, 0.5), 6) AS p50, round(quantile_cont(vs, 0.75), 6) AS p75, round(max(vs), 6) AS p100 FROM m GROUP BY ALL")
def param_percentiles(spark, sf):
    return rounded(inversion.parameter_ranges(models_of(spark, sf), "vs"))


@query(f"WITH {M}, t AS (SELECT model, vs, coalesce(sum(h) OVER (PARTITION BY model ORDER BY layer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM m), d AS (SELECT DISTINCT model, unnest([0, 20, 40, 60, 80, 100, 120]::DOUBLE[]) AS z FROM m) SELECT d.model, d.z, round(t.vs, 6) AS vs FROM d ASOF JOIN t ON d.model = t.model AND d.z >= t.top")
def layer_asof(spark, sf):
    return rounded(inversion.on_depths(models_of(spark, sf), [0, 20, 40, 60, 80, 100, 120], keys=("model",)))


@query(f"WITH {M} SELECT model, layer, round(coalesce(sum(h) OVER w, 0), 6) AS top_min, round(coalesce(sum(h * 2) OVER w, 0), 6) AS top_max FROM m WINDOW w AS (PARTITION BY model ORDER BY layer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def prior_bounds(spark, sf):
    m = models_of(spark, sf).select("model", "layer", F.col("h").alias("h_min"), (F.col("h") * 2).alias("h_max"))
    return rounded(inversion.prior_bounds(m, keys=("model",)).select("model", "layer", "top_min", "top_max"))


# Diagnostics

WELCH = f"""{S}, w AS (SELECT gather, ch, o, CAST(i - 16 * o AS INTEGER) AS i, x FROM s, (SELECT unnest(range(3)) AS o) WHERE i >= 16 * o AND i < 16 * o + 32),
c AS (SELECT gather, ch, o, i, (x - avg(x) OVER (PARTITION BY gather, ch, o)) * (0.5 - 0.5 * cos(2 * pi() * i / 32)) AS x FROM w), {dft('c', n=32, keys='gather, ch, o')},
y AS (SELECT gather, ch, k, avg(CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END * (re * re + im * im) / (64 * 12)) AS p FROM d GROUP BY ALL)"""


@query(f"WITH {WELCH} SELECT gather, CAST(k AS INTEGER) AS k, CAST(k * 2 AS DOUBLE) AS f, round(10 * log10(avg(p) + 1e-12), 4) + 0.0 AS db FROM y GROUP BY gather, k")
def welch_psd(spark, sf):
    return rounded(diagnostics.mean_power_db(diagnostics.power(panel(spark, sf), FS, 32)), 4)


@query(f"WITH {WELCH} SELECT gather, ch, CAST(k AS INTEGER) AS k, round(10 * log10(p + 1e-12), 4) + 0.0 AS db FROM y")
def welch_channels(spark, sf):
    return rounded(diagnostics.power(panel(spark, sf), FS, 32).select("gather", "ch", "k", (10 * F.log10(F.col("p") + 1e-12)).alias("db")), 4)


@query(f"WITH {S}, c AS (SELECT gather, ch, quantile_cont(abs(x), 0.99) AS c FROM s GROUP BY ALL) SELECT gather, round(median(c), 6) AS clip FROM c GROUP BY gather")
def clip_median_of_percentiles(spark, sf):
    return rounded(diagnostics.common_clip(traces.samples(panel(spark, sf)), 0.99, ["gather", "ch"], ["gather"]))


@query(f"WITH {S} SELECT gather, ch, i, round(x / stddev_pop(x) OVER (PARTITION BY gather), 6) + 0.0 AS x FROM s")
def spread_scaled(spark, sf):
    return rounded(diagnostics.scaled_by_spread(traces.samples(panel(spark, sf))).select("gather", "ch", "i", "x"))


@query(f"WITH {IMAGE}, b AS (SELECT *, row_number() OVER (PARTITION BY gather, f ORDER BY p DESC, v) AS n FROM img) SELECT i.gather, i.f, i.v, round(i.p, 4) + 0.0 AS p, b.v AS pick FROM img i LEFT JOIN (SELECT * FROM b WHERE n = 1 AND f >= 10) b ON i.gather = b.gather AND i.f = b.f")
def panel_left_picks(spark, sf):
    image = fv(spark, sf)
    some = imaging.best(image).where(F.col("f") >= 10)
    return rounded(diagnostics.panel_with_picks(image, some, ["gather", "f"]).select("gather", "f", "v", "p", "pick"), 4)


@query(f"WITH {S} SELECT gather, ch, i, round(x - (x - avg(x) OVER {W}), 6) + 0.0 AS d FROM s")
def residual(spark, sf):
    rows = panel(spark, sf)
    return rounded(diagnostics.residual(traces.samples(rows), traces.samples(rows.withColumn("x", arrays.demean("x"))), ["gather", "ch", "i"], "x"))


# Names, files, channels

NAMES = ("strftime(ts, '%Y%m%d_%H%M%S') || CASE WHEN user_id % 3 = 0 THEN '_urban_auto_v1_2M.npy' ELSE '_urban_cc_' || lpad(CAST(user_id % 1000 AS VARCHAR), 3, '0') || '_7d_v1_2M.npy' END")


@query(f"SELECT {NAMES} AS name, date_trunc('second', ts) AS t0, CAST(CASE WHEN user_id % 3 = 0 THEN -1 ELSE user_id % 1000 END AS INTEGER) AS vs, 'v1_2M' AS method, CASE WHEN user_id % 3 = 0 THEN NULL ELSE '7d' END AS label FROM events")
def name_parse(spark, sf):
    e, user = table(spark, sf, "events"), F.col("user_id")
    text = F.concat(F.date_format("ts", "yyyyMMdd_HHmmss"), F.when(user % 3 == 0, "_urban_auto_v1_2M.npy").otherwise(F.concat(F.lit("_urban_cc_"), F.lpad((user % 1000).cast("string"), 3, "0"), F.lit("_7d_v1_2M.npy"))))
    name = F.col("name")
    return e.select(text.alias("name")).select("name", names.stamp(name).cast("timestamp_ntz").alias("t0"), names.source(name).alias("vs"), names.method(name).alias("method"), names.window(name).alias("label"))


@query(f"WITH {S}, t AS (SELECT gather, ch, r % 4 AS part, r // 4 AS j, i, x FROM s), u AS (SELECT gather, part, j * 64 + i AS i, x FROM t) SELECT gather, CAST(part AS INTEGER) AS part, CAST(i AS INTEGER) AS i, round(x - (regr_slope(x, i) OVER w * i + regr_intercept(x, i) OVER w), 6) + 0.0 AS x FROM u WINDOW w AS (PARTITION BY gather, part)")
def merge_sequence(spark, sf):
    files = panel(spark, sf).select("gather", (F.col("r") % 4).alias("part"), F.floor(F.col("r") / 4).alias("t0"), "x")
    return rounded(traces.samples(traces.merged(files, ("gather", "part")), keys=("gather", "part")))


@query(f"WITH {P}, n AS (SELECT *, count(*) OVER (PARTITION BY gather) AS c FROM p) SELECT gather, r AS chan FROM n WHERE c >= 48 AND r < 48")
def channel_window(spark, sf):
    rows = panel(spark, sf)
    counted = rows.join(rows.groupBy("gather").agg(F.count("*").alias("nch")), "gather").withColumnRenamed("r", "row").drop("ch")
    return traces.channel_window(counted.withColumn("row", F.col("row").cast("long")), 100, 147, file_first=100).select("gather", F.col("ch").alias("chan"))


# Without SQL: kernels that it can't express, and sequential picks


@query()
def bandpass_exact(spark, sf):
    return rounded(traces.samples(panel(spark, sf).withColumn("x", traces.band("x", FS, 4.0, 16.0))))


@query()
def decimate(spark, sf):
    return rounded(traces.samples(panel(spark, sf).withColumn("x", traces.decimated("x", FS, 2))))


@query()
def resample(spark, sf):
    return rounded(traces.samples(panel(spark, sf).withColumn("x", traces.resampled("x", 128))))


@query()
def envelope(spark, sf):
    return rounded(traces.samples(panel(spark, sf).withColumn("x", traces.enveloped("x"))))


@query()
def fk_filter(spark, sf):
    return gather_rows(gathers.fan_filter(gather_of(spark, sf), 1 / FS, 1.0, 20.0, 200.0, mode="extract"), -31)


@query()
def outgoing_power(spark, sf):
    return rounded(gathers.outgoing_power(gather_of(spark, sf), 1 / FS, 1.0, 20.0), 4)


@query()
def directional_gather(spark, sf):
    return gather_rows(gathers.directional(gather_of(spark, sf), 1 / FS, 1.0, 20.0, 200.0, "right", 1.0, 30.0), 0)


@query()
def batch_process(spark, sf):
    return gather_rows(gathers.polished(gather_of(spark, sf), 1 / FS, 1.0, 20.0, 200.0, 20, far=30.0, cut=2.0, width=4.0), -20)


TARGETED = tukey_at("j", "n", 0.1)


@query(f"""WITH {G}, c AS (SELECT gather, ch, o, abs(lag) AS lag, x FROM g WHERE o BETWEEN 1 AND 30 AND lag BETWEEN -20 AND 0),
n AS (SELECT *, dense_rank() OVER (PARTITION BY gather ORDER BY o, ch) - 1 AS j, count(*) OVER (PARTITION BY gather, lag) AS n FROM c) SELECT gather, ch, o AS "offset", lag, round(x * {TARGETED}, 6) + 0.0 AS x FROM n""")
def targeted_export(spark, sf):
    return gather_rows(gathers.targeted(gather_of(spark, sf), 0, 20, 20, 1.0, 30.0, "right"), 0)


@query()
def ridge_pick(spark, sf):
    return imaging.ridge(fv(spark, sf), [8.0], [150.0], 2)


@query()
def ridge_multi(spark, sf):
    return imaging.ridge(fv(spark, sf), [5.0, 10.0, 15.0], [200.0, 150.0, 120.0], 2, lowest=40.0)


@query()
def dvv_bands(spark, sf):
    cube = panel(spark, sf).select(F.col("ch").alias("hour"), F.col("gather").alias("src"), (F.col("r") % 4).alias("rec"), "x")
    return rounded(delays.velocity_changes(cube, FS, [(4.0, 12.0), (8.0, 20.0)], 0.1, 0.9, 0.05, 21, 0.2))


@query()
def mccc_delays(spark, sf):
    return rounded(delays.channel_delays(panel(spark, sf), 1 / FS, 0.2, 0.01))


@query()
def mccc_windowed(spark, sf):
    return rounded(delays.windowed_delays(gather_of(spark, sf), FS, [(0.05, 0.3, 0.15), (0.1, 0.45, 0.25)], 0.2, 3))


@query()
def ssim(spark, sf):
    image = fv(spark, sf).withColumnRenamed("p", "a")
    return rounded(fidelity.similarity(image.withColumn("b", F.floor(F.col("a") * 2 + 0.5) / 2.0), ["gather"]))


@query(f"""WITH {S}, m AS (SELECT gather, i, avg(x) AS x FROM s GROUP BY ALL), w AS (SELECT i, {tukey_sql('i', 17, 0.25)} AS w FROM (SELECT CAST(unnest(range(16)) AS INTEGER) AS i)),
o AS (SELECT gather, t, i - 14 * t AS i, x - avg(x) OVER (PARTITION BY gather, t) AS x FROM m, (SELECT CAST(unnest(range(4)) AS INTEGER) AS t) WHERE i BETWEEN 14 * t AND 14 * t + 15),
y AS (SELECT gather, t, i, x * w AS x FROM o JOIN w USING (i)), {dft('y', n=16, keys='gather, t')}
SELECT gather, t, CAST(k AS INTEGER) AS k, k * 4.0::DOUBLE AS f, round(10 * log10((re * re + im * im) * CASE WHEN k IN (0, 8) THEN 1 ELSE 2 END / (64 * (SELECT sum(w * w) FROM w)) + 1e-12), 4) + 0.0 AS db FROM d""")
def spectrogram(spark, sf):
    return rounded(diagnostics.spectrogram(traces.samples(panel(spark, sf)), FS, 16), 4)


@query()
def timelapse_heatmap(spark, sf):
    rows = stream(spark, sf).withColumn("f", (F.col("ch") + 1).cast("double"))
    curves = rows.groupBy("vs", stacking.floor_to("ts", "1d").alias("ts"), "f").agg((F.avg("x") + 100).alias("v"))
    return rounded(imaging.time_lapse(curves, [float(z) for z in range(5, 60, 5)]).withColumn("ts", F.col("ts").cast("timestamp_ntz")))


@query()
def interpolated_section(spark, sf):
    points = picks(spark, sf).groupBy((F.col("dist") % 2).alias("line"), F.col("dist").cast("double").alias("x"), F.floor("f").cast("double").alias("z")).agg(F.avg("v").alias("v"))
    return rounded(diagnostics.interpolated_section(points, 20, 20))


@query()
def smooth_section(spark, sf):
    points = picks(spark, sf).groupBy((F.col("dist") % 2).alias("line"), F.col("dist").cast("double").alias("x"), F.floor("f").cast("double").alias("z")).agg(F.avg("v").alias("v"))
    return rounded(inversion.smooth_section(points, spacing=0.5))


@query()
def invert_curves(spark, sf):
    """The mean of the fifth of all models tried for a station that fit best, run by run taken together, with their misfits."""
    curves = imaging.regularise(picks(spark, sf).select("dist", "f", "v"), 1.0, 9.0, 2.0).select(F.col("dist").alias("station"), "f", "v")
    layers = [(5, 20, 100, 400), (10, 30, 200, 550), (15, 40, 300, 650), (15, 35, 400, 800), (50, 100, 500, 950)]
    tried = inversion.invert(curves, [(*x, 0.32, 0.34) for x in layers], runs=5, particles=20, steps=1500, wave="rayleigh")
    tried = tried.withColumn("model", F.col("run") * F.lit(1 << 32) + F.col("model"))
    return rounded(inversion.mean_model(inversion.best_share(tried, 20.0), columns=("h", "vs", "poisson", "misfit")))


@query()
def sensitivity(spark, sf):
    return rounded(inversion.sensitivity(models_of(spark, sf), [2.0, 4.0, 8.0], keys=("model",), wave="rayleigh"))
