"""Configuration: YAML or JSON files, dotted paths, and the settings of the correlation pipeline with their defaults."""

from __future__ import annotations

import json
import warnings
from pathlib import Path

MISSING = object()


def load(path: str) -> dict:
    kind = Path(path).suffix.lower()
    text = Path(path).read_text()
    if kind in (".yaml", ".yml"):
        import yaml

        return yaml.safe_load(text) or {}
    if kind == ".json":
        return json.loads(text)
    raise ValueError(f"neither YAML nor JSON: {path}")


def get(config: dict, path: str, default=MISSING):
    """The value at a dotted path; KeyError if it isn't there and no default is given."""
    for part in path.split("."):
        if not isinstance(config, dict) or part not in config:
            if default is MISSING:
                raise KeyError(path)
            return default
        config = config[part]
    return config


def put(config: dict, path: str, value) -> None:
    *above, last = path.split(".")
    for part in above:
        config = config.setdefault(part, {})
    config[last] = value


def preprocess_mode(mode: str | None, gpu: bool = False) -> str:
    """exact or spectral. Names of the backends that earlier configurations used are understood."""
    # Earlier names.
    names = {"pure_numpy": "exact", "hybrid": "exact", "pure_torch": "spectral", "exact": "exact", "spectral": "spectral"}
    if mode is None:
        return "exact"
    if mode.lower() not in names:
        raise ValueError(f"no such preprocessing: {mode}")
    return names[mode.lower()]


#: Setting -> (path, default).
SETTINGS = {
    "fs_raw": ("data.fs_raw", None),
    "file_first_chan": ("data.file_first_chan", None),
    "src_stride": ("data.src_stride", 10),
    "min_length_sec": ("data.min_length_sec", 60),
    "dx": ("data.dx", 8.16),
    "f1": ("preprocess.f1", 1.0),
    "f2": ("preprocess.f2", 5.0),
    "ram_win_sec": ("preprocess.ram_win_sec", 0.0),
    "mode": ("xcorr.mode", "conventional"),
    "auto_cc": ("xcorr.auto_cc", False),
    "whitening": ("xcorr.is_spectral_whitening", True),
    "window_freq_hz": ("xcorr.window_freq_hz", 0.0),
    "max_lag_sec": ("xcorr.max_lag_sec", 4.0),
    "xcorr_seg_sec": ("xcorr.xcorr_seg_sec", 8.0),
}


def correlation_settings(config: dict) -> dict:
    """All settings of a correlation run; data.first_chan and data.last_chan must be there."""
    found = {"first_chan": get(config, "data.first_chan"), "last_chan": get(config, "data.last_chan")}
    found |= {name: get(config, path, default) for name, (path, default) in SETTINGS.items()}
    for name, default in (("decimation", 1), ("diff", False)):
        value = get(config, f"ingest.{name}", None)
        if value is None and get(config, f"preprocess.{name}", None) is not None:
            warnings.warn(f"preprocess.{name} is now ingest.{name}", stacklevel=2)
            value = get(config, f"preprocess.{name}")
        found[name] = default if value is None else value
    found["preprocess"] = preprocess_mode(get(config, "preprocess.mode", None))
    if found["mode"] not in ("conventional", "v1"):
        raise ValueError(f"no such correlation: {found['mode']}")
    return found
