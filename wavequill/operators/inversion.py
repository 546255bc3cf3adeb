"""Layered models fitted to dispersion curves: selection, means, ranges, depth profiles, sensitivities, a swarm search."""

from __future__ import annotations

import ctypes

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dsp

#: Tasks that stations are dealt out to, at most.
MAX_TASKS = 10_000


def best_share(models: DataFrame, percent: float, keys=("station",), one_more: bool = True) -> DataFrame:
    """The rows of the percent of a station's models with the least misfit, and one more. models: keys, model, misfit, .."""
    every = Window.partitionBy(*keys)
    placed = models.withColumn("_i", F.dense_rank().over(every.orderBy("misfit", "model"))).withColumn("_n", F.max("_i").over(every))
    return placed.where(F.col("_i") <= F.floor(F.col("_n") * percent / 100) + int(one_more)).drop("_i", "_n")


def mean_model(models: DataFrame, keys=("station",), columns=("h", "vs")) -> DataFrame:
    return models.groupBy(*keys, "layer").agg(*[F.avg(c).alias(c) for c in columns], F.count("*").alias("n"))


def parameter_ranges(models: DataFrame, column: str, keys=("station",)) -> DataFrame:
    """keys, layer, p0, p25, p50, p75, p100 of a column over models."""
    p = F.percentile(column, F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    found = models.groupBy(*keys, "layer").agg(p.alias("p"))
    return found.select(*keys, "layer", *[F.col("p")[i].alias(f"p{x}") for i, x in enumerate((0, 25, 50, 75, 100))])


def layer_tops(models: DataFrame, keys=("station",)) -> DataFrame:
    """models with top and bottom of each layer, from thicknesses h; the last layer has no bottom."""
    order = Window.partitionBy(*keys).orderBy("layer")
    top = F.coalesce(F.sum("h").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return models.withColumn("top", top).withColumn("bottom", F.lead("top").over(order))


def on_depths(models: DataFrame, depths: list[float], column: str = "vs", keys=("station",)) -> DataFrame:
    """keys, z and column of the layer that each depth lies in: a layer meets the depths from its top to before the next."""
    grid = F.broadcast(models.sparkSession.createDataFrame([(float(z),) for z in depths], "z double"))
    tops = layer_tops(models, keys)
    return tops.join(grid, (F.col("z") >= F.col("top")) & (F.col("bottom").isNull() | (F.col("z") < F.col("bottom")))).select(*keys, "z", column)


def prior_bounds(prior: DataFrame, keys=("station",)) -> DataFrame:
    """prior (keys, layer, h_min, h_max, vs_min, vs_max) with the least and greatest depth of each layer's top."""
    order = Window.partitionBy(*keys).orderBy("layer").rowsBetween(Window.unboundedPreceding, -1)
    return prior.select("*", *[F.coalesce(F.sum(f"h_{w}").over(order), F.lit(0.0)).alias(f"top_{w}") for w in ("min", "max")])


def smooth_section(section: DataFrame, keys=("line",), width: float = 1.0, spacing: float = 1.0) -> DataFrame:
    """keys, x, z, v resampled along x by lines at a spacing and blurred by a Gaussian of width samples; one section a task."""
    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        table = frame.pivot(index="z", columns="x", values="v").sort_index().sort_index(axis=1)
        x = table.columns.to_numpy(float)
        fine = np.arange(x[0], x[-1] + spacing / 2, spacing)
        rows = dsp.gaussian_blur(np.stack([np.interp(fine, x, r) for r in table.to_numpy(float)]), width)
        return pd.DataFrame({**dict(zip(keys, key, strict=True)), "x": np.tile(fine, len(rows)), "z": np.repeat(table.index.to_numpy(float), len(fine)), "v": rows.ravel()})

    types = ", ".join(f"{k} {section.schema[k].dataType.simpleString()}" for k in keys)
    return section.groupBy(*keys).applyInPandas(run, f"{types}, x double, z double, v double")


def love_wave_velocity(h: np.ndarray, vs: np.ndarray, rho: np.ndarray, freqs: np.ndarray) -> np.ndarray:
    """Fundamental-mode Love-wave phase velocities of layers over a half-space, by the layers' propagator; nan where none is found."""
    out = np.full(len(freqs), np.nan)
    grid = np.linspace(vs.min() * 1.0001, vs[-1] * 0.9999, 400)
    mu = rho * vs**2
    for k, f in enumerate(freqs):
        w = 2 * np.pi * f

        def surface(c, w=w):
            """Stress at the surface for a motion that decays downward, from the half-space up."""
            c = np.atleast_1d(c)
            wave = w / c
            u, s = np.ones(len(c)), -mu[-1] * np.sqrt(np.maximum(wave**2 - (w / vs[-1]) ** 2, 0))
            for i in range(len(h) - 1, -1, -1):
                q = np.sqrt((w / vs[i]) ** 2 - wave**2 + 0j)
                q = np.where(np.abs(q) < 1e-12, 1e-12, q)
                cos, sin = np.cos(q * h[i]), np.sin(q * h[i])
                u, s = np.real(cos * u - sin / (mu[i] * q) * s), np.real(mu[i] * q * sin * u + cos * s)
                scale = np.maximum(np.abs(u) + np.abs(s) / mu[i], 1e-300)
                u, s = u / scale, s / scale
            return s

        values = surface(grid)
        turn = np.flatnonzero(np.signbit(values[1:]) != np.signbit(values[:-1]))
        if len(turn):
            a, b = grid[turn[0]], grid[turn[0] + 1]
            for _ in range(40):
                m = (a + b) / 2
                a, b = (m, b) if np.signbit(surface(m)[0]) == np.signbit(surface(a)[0]) else (a, m)
            out[k] = (a + b) / 2
    return out


def _rayleigh_function(c, w, h, vs, vp):
    """_secular() for c, w: (models, frequencies, velocities), (frequencies, 1) and h, vs, vp: (models, layers)."""
    shape = np.broadcast_shapes(np.shape(c), np.shape(w), (len(vs), 1, 1))
    each = lambda x: np.broadcast_to(x, shape).ravel()
    layers = [np.stack([each(x[:, i, None, None]) for i in range(x.shape[1])]) if x.shape[1] else np.empty((0, 0)) for x in (h, 1 / vs**2, 1 / vp**2)]
    return _secular(each(c), each(w), *layers).reshape(shape)


def _secular(c, w, h, slow_s, slow_p):
    """The secular function of Rayleigh waves of one density throughout. c, w: velocities and radians a second. h: (layers,
    velocities); slow_s, slow_p: squares of the slownesses, of layers and half-space. Only its sign and zeros matter: it is scaled
    by positive factors on the way."""
    out = np.empty(len(c))
    for k in range(0, len(c), TOGETHER):
        part = slice(k, k + TOGETHER)
        for e in _minors(c[part], w[part], h[:, part], slow_s[:, part], slow_p[:, part]):
            out[part] = e[0]
    return out


def _one_mode(c, w, h, slow_s, slow_p):
    """Whether there is one mode at most that is slower than c, as far as can be told, of layers thinner than CLAMPED.

    Modes are counted by the sign changes of the determinant of motion upward (e5) and the negative eigenvalues of the stiffness
    at the surface, (-e2, +-e3; +-e3, e4) / e5. A thin layer has no more zeros of it than negative eigenvalues below.
    """
    sure, zeros, n, before = np.ones(len(c), bool), np.zeros(len(c), int), 0, None
    for e1, _, _, e4, e5 in _minors(c, w, h, slow_s, slow_p):
        n, now = np.where(e1 * e5 > 0, 1, np.where(e4 * e5 < 0, 2, 0)), np.signbit(e5)
        sure &= n < 2
        zeros += 0 if before is None else now != before
        before = now
    return sure & (zeros + n <= 1)


def _minors(c, w, h, slow_s, slow_p):
    """Dunkin's five minors e1 to e5 of motion and stress at the top of the half-space, and of each layer upward. Layers of no
    thickness are passed over.

    In stiff layers g = 2 (vs / c)^2 is large, and the textbook elements are differences of terms that are g squared times as
    large. Where a layer's vs is above c they are written here without these: m = g (1 - rp rs) and g sinh(a - b) are worked out
    as they are, so rounding stays small whatever the contrast. e1 goes with g and e5 with 1 / g, the others with 1.
    """
    c2, k = c * c, w / c
    ps, ss = c2 * slow_p[-1], c2 * slow_s[-1]
    rp, rs = np.sqrt(np.maximum(1 - ps, 0)), np.sqrt(np.maximum(1 - ss, 0))
    m = 2 * (1 + slow_p[-1] / slow_s[-1] - ps) / (1 + rp * rs)
    e = (1 - (2 - m) * 2 / ss, -rp, m - 1, rs, m * ss / 2)
    yield e
    for i in range(len(h) - 1, -1, -1):
        kh, ps, ss, there = k * h[i], c2 * slow_p[i], c2 * slow_s[i], h[i] != 0
        up = ss >= 1
        if there.all() and not up.any():
            e = _through_stiff(e, kh, ps, ss)
        elif there.any():
            out = np.array(e)
            for at, through in ((np.flatnonzero(there & ~up), _through_stiff), (np.flatnonzero(there & up), _through_soft)):
                if len(at):
                    out[:, at] = through(out[:, at], kh[at], ps[at], ss[at])
            e = tuple(out)
        if i % 8 == 7:
            scale = np.maximum(sum(np.abs(x) for x in e), 1e-300)
            e = tuple(x / scale for x in e)
        yield e


def _through_stiff(e, kh, ps, ss):
    """The minors above a layer from those below it, where c is below its vs. kh: wavenumber by thickness; ps, ss: (c / vp)^2,
    (c / vs)^2. By exp(-a - b), a and b being kh times what waves decay by."""
    rp, rs, g1 = np.sqrt(1 - ps), np.maximum(np.sqrt(1 - ss), 1e-9), ss / 2
    p = rp * rs
    m = 2 * (1 + ps / ss - ps) / (1 + p)
    far = -np.expm1(-kh * (ss - ps) / (rp + rs))
    tb = -np.expm1(-2 * kh * rs)
    eb = 1 - tb
    two = eb * far * (2 - far)
    ta = tb + two
    cc, yy = (1 - tb / 2) * (1 - ta / 2), ta * tb / 4 / p
    cs, one = (1 - ta / 2) * tb / 2, eb * (1 - far)
    s1, d2 = two / ss, eb * (far / g1) ** 2 / 2
    g, n, low = 1 - m, 2 - m - g1, 1 - g1
    c_p, c_s = cs / rp, cs / rs
    s_p, s_s = s1 / rp, s1 * rp
    m11 = cc + 2 * low * d2 - yy * g * g
    m12, m14 = c_s * m - s_s, -c_p * m - s_p
    m13, m15 = (2 - g1) * d2 + yy * m * g, 2 * d2 - yy * m * m
    m21, m23 = n * c_p - low * low * s_p, g * c_p - low * s_p
    m41, m43 = -n * c_s - s_s, -g * c_s - s_s
    m51, m53 = 2 * low * low * d2 - yy * n * n, low * (2 - g1) * d2 - yy * g * n
    e1, e2, e3, e4, e5 = e[0] * g1, e[1], e[2], e[3], e[4] / g1
    e33 = 2 * e3
    return (
        (e1 * m11 + e2 * m21 - e33 * m53 + e4 * m41 + e5 * m51) / g1,
        e1 * m12 + e2 * cc - e33 * m43 - e4 * yy * rp * rp + e5 * m41,
        e1 * m13 + e2 * m23 + e3 * one + e33 * (cc - m11) + e4 * m43 + e5 * m53,
        e1 * m14 - e2 * yy * rs * rs - e33 * m23 + e4 * cc + e5 * m21,
        (e1 * m15 + e2 * m14 - e33 * m13 + e4 * m12 + e5 * m11) * g1,
    )


def _through_soft(e, kh, ps, ss):
    """_through_stiff() where c is not below the layer's vs; g is 2 at most."""
    qp = 1 - ps
    rp, rs, g = np.maximum(np.sqrt(np.abs(qp)), 1e-9), np.maximum(np.sqrt(ss - 1), 1e-9), 2 / ss
    a, b, up = kh * rp, kh * rs, qp <= 0
    t = -np.expm1(-a)
    one = 1 - t
    ca, sin, ca_less = (1 + one * one) / 2, t * (2 - t) / 2, t * t / 2
    if up.any():
        x = a[up]
        ca[up], sin[up], ca_less[up], one[up] = np.cos(x), np.sin(x), -2 * np.sin(x / 2) ** 2, 1
    cw, cx = sin / rp, np.where(up, -rp, rp) * sin
    cb, sin = np.cos(b), np.sin(b)
    cy, cz = sin / rs, -rs * sin
    less = -ca_less * cb + 2 * one * np.sin(b / 2) ** 2
    xz, wy, cc, f = cx * cz, cw * cy, ca * cb, g - 1
    cpy, cpz, cqw, cqx = ca * cy, ca * cz, cb * cw, cb * cx
    gg, ff, gf = g * g, f * f, g * f
    m11 = cc - 2 * gf * less - gg * xz - ff * wy
    m12, m14 = cpy - cqx, cpz - cqw
    m13, m15 = -((g + f) * less + g * xz + f * wy), -(2 * less + xz + wy)
    m21, m23 = gg * cpz - ff * cqw, g * cpz - f * cqw
    m41, m43 = ff * cpy - gg * cqx, f * cpy - g * cqx
    m51, m53 = -(2 * gf * gf * less + gg * gg * xz + ff * ff * wy), -(gf * (g + f) * less + gg * g * xz + ff * f * wy)
    e1, e2, e3, e4, e5 = e
    e33 = 2 * e3
    return (
        e1 * m11 + e2 * m21 - e33 * m53 + e4 * m41 + e5 * m51,
        e1 * m12 + e2 * cc - e33 * m43 - e4 * cx * cy + e5 * m41,
        e1 * m13 + e2 * m23 + e3 * one + e33 * (cc - m11) + e4 * m43 + e5 * m53,
        e1 * m14 - e2 * cw * cz - e33 * m23 + e4 * cc + e5 * m21,
        e1 * m15 + e2 * m14 - e33 * m13 + e4 * m12 + e5 * m11,
    )


#: Radians of vertical phase in all layers, of both waves, below which no mode but the fundamental can be: standing waves need pi / 2.
ONE_MODE = 0.5
#: Radians of a shear wave in a layer up to which it has no mode of its own with one face held and the other free; that needs pi / 2.
CLAMPED = 1.0
#: Velocities that are worked out together, so that the arrays stay in a core's cache, and those that searches go on with.
TOGETHER, SEARCHED = 8192, 1 << 17


def _keep_memory() -> None:
    """Freed arrays stay with the process, which glibc would otherwise hand back and fault in anew with every few operations."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
        mallopt(-1, 1 << 26), mallopt(-3, 1 << 25)
    except (AttributeError, OSError, TypeError):
        pass  # another C library


def rayleigh_wave_velocity(h: np.ndarray, vs: np.ndarray, vp: np.ndarray, freqs: np.ndarray, points: int = 160) -> np.ndarray:
    """Fundamental-mode Rayleigh-wave phase velocities (models, frequencies) of layers of one density over a half-space; nan
    where none is found below the half-space's vs. h: (models, layers); vs, vp: (models, layers and half-space).

    The first change of sign on a grid of velocities, and the zero within it. Where layers are too thin for a second mode
    (ONE_MODE), or none is counted, there is one change at most and no need for the grid.
    """
    return _rayleigh(h, vs, vp, freqs, points)[0]


def _rayleigh(h, vs, vp, freqs, points=160, near=None):
    """rayleigh_wave_velocity(), and the secular function's slopes there, where they are known. near: the same two of models much
    like these, to begin from."""
    h, vs, vp = (np.atleast_2d(np.asarray(x, float)) for x in (h, vs, vp))
    w = 2 * np.pi * np.asarray(freqs, float)
    out, slopes = np.full((2, len(vs), len(w)), np.nan)
    low, high = 0.7 * vs.min(1), vs[:, -1] * 0.999999
    slow = lambda v: np.sqrt(np.maximum(1 / v[:, :-1] ** 2 - 1 / high[:, None] ** 2, 0))
    layers = [np.ascontiguousarray(x.T) for x in (h, 1 / vs**2, 1 / vp**2)]
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        one, there = (h * (slow(vs) + slow(vp))).sum(1)[:, None] * w < ONE_MODE, (low < high)[:, None]
        m, f = np.nonzero(there & ~one & ((h / vs[:, :-1]).max(1, initial=0)[:, None] * w < CLAMPED))
        for k in range(0, len(m), TOGETHER):
            a, b = m[k : k + TOGETHER], f[k : k + TOGETHER]
            one[a, b] = _one_mode(high[a], w[b], *(x[:, a] for x in layers))
        for single, wanted in ((True, there & one), (False, there & ~one)):
            at = np.nonzero(wanted)
            step = SEARCHED if single else max(1, SEARCHED // points)
            for k in range(0, len(at[0]), step):
                m, f = at[0][k : k + step], at[1][k : k + step]
                these, ends = [w[f], *(x[:, m] for x in layers)], (low[m], high[m])
                if single:
                    out[m, f], slopes[m, f] = _only_zero(these, *ends, 0.93 * vs[m, -1], None if near is None else [x[m, f] for x in near])
                else:
                    value, some = _function_of(these)
                    out[m, f] = _first_zero(value, *_cells(value, *ends, points), some)
    return out, slopes


def _function_of(these):
    """value(velocities of each row) -> the same shape, of w, h and slownesses as _secular() has them, and that of some rows."""
    some = lambda rows: _function_of([x[..., rows] for x in these])[0]
    return (lambda c: _secular(c.ravel(), *(np.repeat(x, c.shape[1], -1) for x in these)).reshape(c.shape)), some


def _only_zero(these, low, high, guess, near):
    """The zero between low and high where there is one at most, and the slope there if it is known."""
    out, slopes = np.full((2, len(low)), np.nan) if near is None else _by_secants(these, low, high, *near)
    at = np.flatnonzero(np.isnan(out))
    if len(at):
        a, b = _function_of(these)[1](at)(np.stack([low[at], high[at]], 1)).T
        turns = np.signbit(a) != np.signbit(b)
        at, a, b = at[turns], a[turns], b[turns]
    if len(at):
        these, low, high = [x[..., at] for x in these], low[at], high[at]
        out[at], slopes[at] = _by_secants(these, low, high, np.maximum(guess[at], (low + high) / 2))
        left = np.isnan(out[at])
        out[at[left]] = _first_zero(None, low, high, a, b, ~left, _function_of(these)[1])[left]
    return out, slopes


def _by_secants(these, low, high, start, slopes=None):
    """The zero between low and high that secants from start lead to, the first by slopes if there are some, and the slope there;
    nan where they leave low and high or take more than a few steps."""
    out, at = np.full((2, len(start)), np.nan), np.flatnonzero((start > low) & (start < high))
    c0, low, high, these = start[at], low[at], high[at], [x[..., at] for x in these]
    f0 = _secular(c0, *these)
    c1 = c0 * (1 - 2e-3) if slopes is None else c0 - f0 / slopes[at]
    for _ in range(10):
        left = np.flatnonzero((c1 > low) & (c1 < high))
        at, c0, f0, c1, low, high, these = at[left], c0[left], f0[left], c1[left], low[left], high[left], [x[..., left] for x in these]
        if not len(at):
            break
        f1 = _secular(c1, *these)
        slope = (f1 - f0) / (c1 - c0)
        step = -f1 / slope
        c2 = c1 + step
        # The next error is some way below the product of the last two; where both steps are nothing there is no slope.
        done = (np.abs(step * (c1 - c0)) < 1e-16 * c1 * c1) & (c2 > low) & (c2 < high) | (f1 == 0)
        out[:, at[done]] = np.where(f1 == 0, c1, c2)[done], slope[done]
        c0, f0, c1 = c1, f1, np.where(done, np.nan, c2)
    return out


def _cells(value, low, high, n):
    """Of each row's grid of n cells from low to high the first in which value (velocities of each row -> the same shape) changes
    its sign: low, high, the values there, and whether there is none."""
    c = low[:, None] + (high - low)[:, None] * np.linspace(0, 1, n + 1)
    values = value(c)
    turns = np.signbit(values[:, 1:]) != np.signbit(values[:, :-1])
    j = turns.argmax(1)[:, None]
    return *(np.take_along_axis(x, i, 1)[:, 0] for x, i in ((c, j), (c, j + 1), (values, j), (values, j + 1))), ~turns.any(1)


def _first_zero(value, low, high, a, b, missing, some=None):
    """The zero in cells as _cells() has them, to rounding, by Chandrupatla's method: inverse quadratic steps, or else halves.
    some: value for some rows only."""
    out, at = np.full(len(low), np.nan), np.flatnonzero(~missing)
    x1, f1, x2, f2, t = high[at], b[at], low[at], a[at], np.full(len(at), 0.5)
    for _ in range(200):
        if not len(at):
            break
        x = x1 + t * (x2 - x1)
        if some:
            f = some(at)(x[:, None])[:, 0]
        else:
            every = high.copy()
            every[at] = x
            f = value(every[:, None])[at, 0]
        same = np.signbit(f) == np.signbit(f1)
        x3, f3 = np.where(same, x1, x2), np.where(same, f1, f2)
        x2, f2 = np.where(same, x2, x1), np.where(same, f2, f1)
        x1, f1 = x, f
        best = np.where(np.abs(f1) <= np.abs(f2), x1, x2)
        out[at] = best
        least = 2e-15 * np.abs(best) / np.abs(x2 - x1)
        xi, phi = (x1 - x2) / (x3 - x2), (f1 - f2) / (f3 - f2)
        smooth = (phi**2 < xi) & ((1 - phi) ** 2 < 1 - xi)
        t = np.where(smooth, f1 / (f2 - f1) * f3 / (f2 - f3) + (x3 - x1) / (x2 - x1) * f1 / (f3 - f1) * f2 / (f3 - f2), 0.5)
        t = np.clip(t, least, 1 - least)
        left = np.flatnonzero((least < 0.5) & (f1 != 0))
        at, x1, f1, x2, f2, t = at[left], x1[left], f1[left], x2[left], f2[left], t[left]
    return out


def _modelled(wave: str, h: np.ndarray, vs: np.ndarray, poisson: np.ndarray | None, f: np.ndarray) -> np.ndarray:
    """Phase velocities (models, frequencies) of layers over a half-space, of one density. Without poisson, vp is twice vs."""
    if wave == "rayleigh":
        vp = 2 * vs if poisson is None else vs * np.sqrt((2 - 2 * poisson) / (1 - 2 * poisson))
        return rayleigh_wave_velocity(h, vs, vp, f)
    if wave != "love":
        raise ValueError(f"no such wave: {wave}")
    return np.stack([love_wave_velocity(a, b, np.full(len(b), 2000.0), f) for a, b in zip(h, vs, strict=True)])


def invert(curves: DataFrame, bounds: list[tuple[float, ...]], runs: int = 2, particles: int = 20, steps: int = 30, seed: int = 42, keys=("station",), wave: str = "love") -> DataFrame:
    """keys, run, model, layer, h, vs, misfit: layered models of shear velocity by a competing swarm, runs times for each
    station. curves: keys, f, v. bounds: h_min, h_max, vs_min, vs_max of each layer, the half-space last, and for all or
    none least and greatest Poisson's ratios, which are searched then and returned as poisson. Velocities that don't grow with
    depth are put in order. Every model that was tried is returned once.

    wave: love, or rayleigh; vp is twice vs without Poisson's ratios.
    """
    low, high = np.array(bounds, float)[:, 0::2], np.array(bounds, float)[:, 1::2]
    ratios = low.shape[1] > 2

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("f")
        f, v = frame["f"].to_numpy(), frame["v"].to_numpy()
        streams = [np.random.default_rng(seed + r) for r in range(runs)]
        draw = lambda *shape: np.stack([g.random((*shape, *low.shape)) for g in streams])
        order = lambda x: np.concatenate([x[..., :1], np.sort(x[..., 1:2], axis=-2), x[..., 2:]], -1)

        def misfits(m):
            flat = m.reshape(-1, *low.shape)
            got = _modelled(wave, flat[:, :-1, 0], flat[:, :, 1], flat[:, :, 2] if ratios else None, f)
            some = np.isfinite(got).any(1)
            out = np.full(len(flat), np.inf)
            out[some] = np.sqrt(np.nanmean((got[some] - v) ** 2, axis=1))
            return out.reshape(m.shape[:2])

        # All runs go together, each with random numbers of its own, so that few large arrays are worked on.
        swarm = order(low + draw(particles) * (high - low))
        speed, costs, row = np.zeros_like(swarm), misfits(swarm), np.arange(runs)[:, None]
        seen, seen_costs = [swarm.copy()], [costs.copy()]
        for _ in range(steps):
            # Particles meet in pairs; the worse learns from the better.
            pairs = np.stack([g.permutation(particles) for g in streams])
            a, b = pairs[:, ::2][:, : particles // 2], pairs[:, 1::2]
            first = costs[row, a] <= costs[row, b]
            win, lose = np.where(first, a, b), np.where(first, b, a)
            r = draw(lose.shape[1], 3)
            mine, mean = swarm[row, lose], swarm.mean(1, keepdims=True)
            speed[row, lose] = r[:, :, 0] * speed[row, lose] + r[:, :, 1] * (swarm[row, win] - mine) + 0.1 * r[:, :, 2] * (mean - mine)
            swarm[row, lose] = order(np.clip(mine + speed[row, lose], low, high))
            costs[row, lose] = misfits(swarm[row, lose])
            seen.append(swarm[row, lose])
            seen_costs.append(costs[row, lose])
        models, cost = np.concatenate(seen, 1), np.concatenate(seen_costs, 1)
        of_run, kept = np.nonzero(np.isfinite(cost))
        n, m = len(low), models[of_run, kept].reshape(-1, low.shape[1])
        found = {"run": np.repeat(of_run, n), "model": np.repeat(kept, n), "layer": np.tile(np.arange(n), len(kept)), "h": m[:, 0], "vs": m[:, 1], **({"poisson": m[:, 2]} if ratios else {}), "misfit": np.repeat(cost[of_run, kept], n)}
        return pd.DataFrame({**{k: np.repeat(x, len(m)) for k, x in zip(keys, key, strict=True)}, **found})

    types = ", ".join(f"{k} {curves.schema[k].dataType.simpleString()}" for k in keys)
    # A curve is little data and much work, so curves are dealt out by number and not by size.
    tasks = max(1, min(MAX_TASKS, curves.select(*keys).distinct().count()))
    return curves.repartition(tasks, *keys).groupBy(*keys).applyInPandas(run, f"{types}, run int, model long, layer long, h double, vs double, {'poisson double, ' if ratios else ''}misfit double")


def sensitivity(models: DataFrame, freqs: list[float], step: float = 0.01, keys=("station",), wave: str = "love") -> DataFrame:
    """keys, layer, f, s: how much the phase velocity changes with each layer's shear velocity, by finite differences. wave: love,
    or rayleigh with a vp of twice vs, which is held. Models of as many layers are worked on together."""
    f = np.asarray(freqs, float)

    def changes(h, vs, top):
        """(changed layers, frequencies), model by model, from h, vs (models, layers), the layers from top on."""
        m, j = np.nonzero(np.arange(vs.shape[1]) >= top[:, None])
        here, many = (np.arange(len(m)), j), h[m, :-1]
        up, down = vs[m], vs[m]
        up[here] *= 1 + step
        down[here] *= 1 - step
        if wave == "rayleigh":
            # Changed models are searched from the model's own velocity, and those changed the other way from its mirror image.
            own, slopes = (x[m] for x in _rayleigh(h[:, :-1], vs, 2 * vs, f))
            faster = _rayleigh(many, up, 2 * vs[m], f, near=(own, slopes))[0]
            slower = _rayleigh(many, down, 2 * vs[m], f, near=(2 * own - faster, slopes))[0]
        else:
            faster, slower = (np.concatenate([_modelled(wave, a[None, t:], b[None, t:], None, f) for a, b, t in zip(many, x, top[m], strict=True)]) for x in (up, down))
        return (faster - slower) / (2 * step * vs[m, j][:, None])

    @F.pandas_udf("array<double>")
    def run(h: pd.Series, vs: pd.Series) -> pd.Series:
        _keep_memory()
        out, sizes = np.empty(len(h), object), h.map(len).to_numpy()
        # Models of as many layers stay together. Above those of fewer come layers of no thickness.
        order = np.argsort(sizes, kind="stable")
        widest = sizes.max(initial=0)
        cube = np.zeros((len(h), widest)), np.full((len(h), widest), np.inf)
        real = np.arange(widest) >= (widest - sizes[order])[:, None]
        for x, c in zip(cube, (h.to_numpy(), vs.to_numpy()), strict=True):
            if len(c):
                x[real] = np.concatenate(c[order])
        if len(h):
            found = changes(*cube, widest - sizes[order])
            for at, s in zip(order, np.split(found, np.cumsum(sizes[order])[:-1]), strict=True):
                out[at] = s.ravel()
        return pd.Series(out)

    layers = F.array_sort(F.collect_list(F.struct(F.col("layer").isNull().alias("last"), F.col("layer").alias("layer"), F.col("h").cast("double").alias("h"), F.col("vs").cast("double").alias("vs"))))
    # A model is little data and much work, so models are dealt out by number and not by size.
    tasks = int(models.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = models.repartition(tasks, *keys).groupBy(*keys).agg(layers.alias("m"))
    flat = whole.select(*keys, run(F.col("m.h"), F.col("m.vs")).alias("s")).select(*keys, F.posexplode("s").alias("i", "s"))
    f_of = F.get(F.array(*[F.lit(float(x)) for x in f]), F.col("i") % len(f))
    return flat.select(*keys, F.floor(F.col("i") / len(f)).cast("int").alias("layer"), f_of.alias("f"), F.nanvl("s", F.lit(None).cast("double")).alias("s"))
