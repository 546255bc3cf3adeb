"""Column expressions over traces held as array<double>, all inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F



def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value, use) -> Column:
    """use(value), with value worked out once: inside a lambda it would be again for every element."""
    return F.transform(F.array(value), use)[0]


def total(x) -> Column:
    return F.aggregate(col(x), F.lit(0.0), lambda a, v: a + v)


def mean(x) -> Column:
    return F.try_divide(total(x), F.size(col(x)))


def dot(x, y) -> Column:
    return total(F.zip_with(col(x), col(y), lambda a, b: a * b))


def peak(x) -> Column:
    return F.array_max(F.transform(col(x), F.abs))


def demean(x) -> Column:
    return once(mean(x), lambda m: F.transform(col(x), lambda v: v - m))


def detrend(x) -> Column:
    """Least-squares line taken out; sums of the sample's number are in closed form."""
    x, n = col(x), F.size(col(x)).cast("double")
    si, sii = n * (n - 1) / 2, n * (n - 1) * (2 * n - 1) / 6
    sx, six = total(x), total(F.transform(x, lambda v, i: v * i))
    slope = lambda s: F.coalesce(F.try_divide(n * s["six"] - si * s["sx"], n * sii - si * si), F.lit(0.0))
    line = lambda s: once(slope(s), lambda b: F.struct(b.alias("slope"), F.try_divide(s["sx"] - b * si, n).alias("level")))
    sums = F.struct(sx.alias("sx"), six.alias("six"))
    return once(sums, lambda s: once(line(s), lambda p: F.transform(x, lambda v, i: v - p["slope"] * i - p["level"])))


def gradient(x, fs: float = 1.0) -> Column:
    """Central differences, one-sided at the ends, a second. A single sample has 0."""
    x = col(x)
    last = F.size(x) - 1

    def at(v, i):
        after, before = F.get(x, F.least(i + 1, last)), F.get(x, F.greatest(i - 1, F.lit(0)))
        return F.coalesce(F.try_divide(after - before, F.least(i + 1, last) - F.greatest(i - 1, F.lit(0))), F.lit(0.0)) * fs

    return F.transform(x, at)


def one_bit(x) -> Column:
    return F.transform(col(x), lambda v: F.signum(v))


def normalise(x) -> Column:
    """Over the peak; a dead trace is 0."""
    return once(peak(x), lambda top: F.transform(col(x), lambda v: F.when(top > 0, v / F.nullif(top, F.lit(0.0))).otherwise(0.0)))


def z_score(x) -> Column:
    x = col(x)
    sd = lambda m: F.sqrt(F.try_divide(total(F.transform(x, lambda v: (v - m) * (v - m))), F.size(x) - 1))
    moments = once(mean(x), lambda m: F.struct(m.alias("m"), sd(m).alias("sd")))
    return once(moments, lambda s: F.transform(x, lambda v: (v - s["m"]) / (s["sd"] + 1e-12)))


def running_absolute_mean(x, n: int) -> Column:
    """x over the mean magnitude of n samples around each; ends are continued by their sample."""
    x = col(x)
    if n <= 1:
        return one_bit(x)
    last = F.size(x) - 1
    window = lambda i: F.transform(F.sequence(i - n // 2, i + (n - 1 - n // 2)), lambda j: F.abs(F.get(x, F.greatest(F.lit(0), F.least(j, last)))))
    return F.transform(x, lambda v, i: F.coalesce(F.try_divide(v, total(window(i)) / n), F.lit(0.0)))


def taper_weight(i, n, alpha: float) -> Column:
    """The Tukey window's weight of sample i of n."""
    edge = alpha * (n - 1) / 2.0
    near = F.least(i, n - 1 - i).cast("double")
    return F.when(near < edge, 0.5 * (1 + F.cos(math.pi * (near / F.nullif(edge, F.lit(0.0)) - 1)))).otherwise(1.0)


def taper(x, alpha: float) -> Column:
    x = col(x)
    return x if alpha <= 0 else F.transform(x, lambda v, i: v * taper_weight(i, F.size(x), min(alpha, 1.0)))


def fold(x) -> Column:
    """The mean of both sides of an odd, centred correlation, from lag 0 on."""
    x = col(x)
    half = F.floor(F.size(x) / 2).cast("int")
    return F.zip_with(F.reverse(F.slice(x, 1, half + 1)), F.slice(x, half + 1, half + 1), lambda a, b: (a + b) / 2)


def causal(x) -> Column:
    x = col(x)
    half = F.floor(F.size(x) / 2).cast("int")
    return F.slice(x, half + 1, half + 1)


def acausal(x) -> Column:
    x = col(x)
    return F.reverse(F.slice(x, 1, F.floor(F.size(x) / 2).cast("int") + 1))


def crop_lags(x, lags: int) -> Column:
    """2 lags + 1 samples around the middle."""
    x = col(x)
    return F.slice(x, F.floor(F.size(x) / 2).cast("int") - lags + 1, 2 * lags + 1)
