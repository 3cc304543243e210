"""Row comparison that ignores order and the last digits of doubles."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, (int, np.integer)):
        return int(value)
    if isinstance(value, (float, np.floating)):
        value = float(value)
        if math.isnan(value):
            return None
        return int(value) if value.is_integer() and abs(value) < 1e15 else float(f"{value:.9g}")
    if isinstance(value, pd.Timestamp):
        return str(value.date()) if value == value.normalize() else str(value)
    if isinstance(value, (list, np.ndarray)):
        return str([plain(v) for v in value])
    return str(value)


def rows(frame: pd.DataFrame) -> list[tuple]:
    names = sorted(frame.columns)
    return sorted((tuple(plain(v) for v in r) for r in frame[names].itertuples(index=False)), key=repr)
