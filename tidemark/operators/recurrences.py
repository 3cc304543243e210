"""Recurrences and trailing ranks over one series, in pandas and numpy; imported by Python workers."""

from __future__ import annotations

import numpy as np
import pandas as pd

#: Wilder's smoothing of the relative strength index.
RSI = 14
#: Spans of the fast, slow and signal averages.
MACD = (12, 26, 9)
SMOOTHED = {n: "double" for n in ("rsi_14", "macd", "macd_signal", "macd_histogram", "macd_pct", "macd_signal_pct", "macd_histogram_pct")}


#: Places of today's value among the last year's, by the column that they rank.
PERCENTILES = {"percentile_price_252d": "close", "percentile_volume_252d": "volume", "percentile_volatility_252d": "volatility_20d"}
RANKED = dict.fromkeys(PERCENTILES, "double")
YEAR = 252


def trailing_percentile(x: np.ndarray, size: int = YEAR) -> np.ndarray:
    """(values below + half the other equal ones) / (size - 1) in the trailing window; NaN unless it is full."""
    out = np.full(len(x), np.nan)
    if len(x) >= size:
        held = np.lib.stride_tricks.sliding_window_view(x, size)
        own = held[:, -1:]
        out[size - 1 :] = ((held < own).sum(axis=1) + ((held == own).sum(axis=1) - 1) / 2) / (size - 1)
        out[size - 1 :][np.isnan(held).any(axis=1)] = np.nan
    return out


def _nulled(values: np.ndarray | pd.Series, index: pd.Index) -> pd.Series:
    column = pd.Series(np.asarray(values, float), index=index).replace([np.inf, -np.inf], np.nan)
    return column.astype(object).where(column.notna(), None)


def ranked(series: pd.DataFrame) -> pd.DataFrame:
    """The trailing percentiles of one series."""
    series = series.sort_values("trading_date")
    found = {name: trailing_percentile(series[x].astype(float).to_numpy()) for name, x in PERCENTILES.items()}
    return series.assign(**{name: _nulled(v, series.index) for name, v in found.items()})


def smoothed_and_ranked(series: pd.DataFrame) -> pd.DataFrame:
    return ranked(smoothed(series))


def smoothed(series: pd.DataFrame) -> pd.DataFrame:
    """rsi_14 and the MACD columns of one series."""
    series = series.sort_values("trading_date")
    x = series["close"]
    step = x.diff()
    gain = step.clip(lower=0).ewm(alpha=1 / RSI, adjust=False, min_periods=RSI).mean()
    loss = (-step.clip(upper=0)).ewm(alpha=1 / RSI, adjust=False, min_periods=RSI).mean()
    strength = 100 - 100 / (1 + gain / loss.where(loss != 0))
    strength = strength.mask((loss == 0) & gain.notna(), 100.0)
    fast, slow = (x.ewm(span=n, adjust=False).mean() for n in MACD[:2])
    macd = fast - slow
    signal = macd.ewm(span=MACD[2], adjust=False).mean()
    out = {"rsi_14": strength, "macd": macd, "macd_signal": signal, "macd_histogram": macd - signal, "macd_pct": macd / x, "macd_signal_pct": signal / x, "macd_histogram_pct": (macd - signal) / x}
    return series.assign(**{n: _nulled(v, series.index) for n, v in out.items()})
