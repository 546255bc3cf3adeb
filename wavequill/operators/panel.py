"""One file's panel from raw samples to correlations, without Spark."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd

from ..functions import dsp


def window_rows(nch: int, first: int, last: int, file_first: int | None) -> tuple[int, int] | None:
    """The rows of channels first to last in a file of nch, or None if it lacks any; as in operators.traces.channel_window."""
    n = last - first + 1
    if file_first is not None:
        start = first - file_first
        return (start, start + n) if start >= 0 and start + n <= nch else None
    if nch > last:
        return first, last + 1
    return (0, n) if nch >= n else None


def correlate_one(row, s: dict) -> pd.DataFrame | None:
    """vs, ch, r of a panel row under settings s; None if it is left out."""
    panel, fs = np.asarray(row.x, float).reshape(int(row.nch), -1), float(row.fs)
    rows = window_rows(len(panel), s["first_chan"], s["last_chan"], s["file_first_chan"])
    if rows is None or panel.shape[1] < s["min_length_sec"] * fs:
        warnings.warn(f"{row.file}: too few channels or samples, left out", stacklevel=2)
        return None
    panel = panel[rows[0] : rows[1]]
    if s["fs_raw"] and abs(fs / s["fs_raw"] - 1) > 1e-3:
        warnings.warn(f"{row.file}: {fs} samples a second, not {s['fs_raw']} as configured", stacklevel=2)
    panel = dsp.decimate(panel, fs, s["decimation"], s["f2"])
    fs /= s["decimation"]
    if s["diff"]:
        panel = np.gradient(panel, axis=-1) * fs
    panel = dsp.preprocess(panel, fs, s["f1"], s["f2"], s["ram_win_sec"], s["preprocess"])
    size, lags = int(round(s["xcorr_seg_sec"] * fs)), int(round(s["max_lag_sec"] * fs))
    count = panel.shape[1] // size
    if not count:
        return None
    panel = panel[:, : count * size]
    if s["whitening"]:
        panel = dsp.whiten_segments(panel, fs, size, s["f1"], s["f2"], s["window_freq_hz"])
    cube = panel.reshape(len(panel), count, size)
    correlate = dsp.correlate_blocks if s["mode"] == "v1" else dsp.correlate_spectra
    if s["auto_cc"]:
        r = np.stack([correlate(cube[c : c + 1], cube[c : c + 1], lags)[0, 0] for c in range(len(cube))])[None]
        sources = np.array([-1])
    else:
        sources = np.arange(0, len(cube), s["src_stride"])
        r = correlate(cube[sources], cube, lags)
    n = len(cube)
    return pd.DataFrame({"file": row.file, "t0": row.t0, "vs": np.repeat(sources, n).astype(np.int32), "ch": np.tile(np.arange(n, dtype=np.int32), len(sources)), "method": s["mode"], "r": list(r.reshape(-1, r.shape[-1]).astype(np.float32))})
