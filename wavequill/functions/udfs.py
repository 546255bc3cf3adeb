"""Kernels of dsp.py as vectorised functions of array columns: traces of one length are one matrix."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _by_length(column: pd.Series, kernel: Callable) -> pd.Series:
    out = np.empty(len(column), object)
    sizes = column.map(lambda v: -1 if v is None else len(v)).to_numpy()
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        if n > 0:
            made = kernel(np.stack(column.iloc[at].to_list()).astype(float))
            for i, row in zip(at, made, strict=True):
                out[i] = row
        elif n == 0:
            for i in at:
                out[i] = np.zeros(0)
    return pd.Series(out)


def trace_map(kernel: Callable):
    """A column function array<double> -> array<double> of a kernel matrix -> matrix. Null traces stay null."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return _by_length(x, kernel)

    return run


def trace_pair(kernel: Callable):
    """A column function of two array<double> columns; kernel: two matrices -> matrix."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        both = pd.Series([None if a is None or b is None else np.stack([a, b]).ravel() for a, b in zip(x, y, strict=True)], dtype=object)
        return _by_length(both, lambda m: kernel(m[:, : m.shape[1] // 2], m[:, m.shape[1] // 2 :]))

    return run
