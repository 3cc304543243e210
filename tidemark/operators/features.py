"""The quantitative features of a (split-adjusted) daily history.

Every function takes a frame with ticker, trading_date, open, high, low, close and volume, and returns
named column expressions over each ticker's history in order of date. A rolling value is null until
its frame is full; null is the only missing value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.recurrences import RANKED, SMOOTHED, ranked, smoothed, smoothed_and_ranked
from tidemark.operators.windows import by_time, change, full, per_series, rolling_beta, rolling_correlation

YEAR = 252
#: Features without which a row can't be used by a model (fixed values).
ESSENTIAL = (
    "return_60d", "momentum_120d", "volatility_60d", "rsi_14", "atr_pct", "distance_ma200",
    "volume_ratio_20d", "max_drawdown_60d", "spy_return_20d", "correlation_spy_20d", "beta_20d",
)


def window(keys: list[str] | None = None):
    return by_time(keys or ["ticker"], "trading_date")


def returns(w) -> dict[str, Column]:
    return {f"return_{n}d": change(F.col("close"), n, w) for n in (1, 2, 5, 10, 20, 60)}


def momentum(w) -> dict[str, Column]:
    return {f"momentum_{n}d": change(F.col("close"), n, w) for n in (5, 10, 20, 60, 120)}


def volatility(w) -> dict[str, Column]:
    """Needs return_1d."""
    r = F.col("return_1d")
    return {f"volatility_{n}d": full(F.stddev_samp, r, n, w) * F.sqrt(F.lit(float(YEAR))) for n in (5, 10, 20, 60)}


def downside_volatility(w) -> dict[str, Column]:
    """Needs return_1d; the missing first return counts as 0, so the first value is at bar 20."""
    loss = F.coalesce(F.least(F.col("return_1d"), F.lit(0.0)), F.lit(0.0))
    frame = w.rowsBetween(-19, 0)
    return {"downside_volatility": F.when(F.count(F.lit(1)).over(frame) == 20, F.sqrt(F.avg(loss * loss).over(frame)) * F.sqrt(F.lit(float(YEAR))))}


def gaps(w) -> dict[str, Column]:
    gap = F.try_divide(F.col("open"), F.lag(F.col("close")).over(w)) - 1
    return {"gap_open": gap, "overnight_return": gap, "intraday_return": F.try_divide(F.col("close"), F.col("open")) - 1}


def true_range(w) -> dict[str, Column]:
    before = F.lag(F.col("close")).over(w)
    return {"true_range": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))}


def average_true_range(w) -> dict[str, Column]:
    """Needs true_range."""
    atr = full(F.avg, F.col("true_range"), 14, w)
    return {"atr_14": atr, "atr_pct": F.try_divide(atr, F.col("close"))}


def moving_averages(w) -> dict[str, Column]:
    return {f"distance_ma{n}": F.try_divide(F.col("close") - full(F.avg, F.col("close"), n, w), full(F.avg, F.col("close"), n, w)) for n in (10, 20, 50, 200)}


def volumes(w) -> dict[str, Column]:
    out = {f"volume_ratio_{n}d": F.try_divide(F.col("volume"), full(F.avg, F.col("volume"), n, w)) for n in (5, 20)}
    out["volume_change_1d"] = change(F.col("volume"), 1, w)
    return out | {f"avg_dollar_volume_{n}d": full(F.avg, F.col("close") * F.col("volume"), n, w) for n in (20, 60)}


def drawdowns(w) -> dict[str, Column]:
    """Least ratio of a price to the running maximum of its own window, minus 1."""

    def of(n: int) -> Column:
        frame = w.rowsBetween(-(n - 1), 0)
        start = F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("worst"))

        def step(a, x):
            top = F.greatest(a["top"], x)
            return F.struct(top.alias("top"), F.least(a["worst"], F.try_divide(x, top) - 1).alias("worst"))

        return F.when(F.count(F.col("close")).over(frame) == n, F.aggregate(F.collect_list(F.col("close")).over(frame), start, step, lambda a: a["worst"]))

    return {f"max_drawdown_{n}d": of(n) for n in (20, 60)}


def year_range(w) -> dict[str, Column]:
    return {"distance_52w_high": F.try_divide(F.col("close"), full(F.max, F.col("close"), YEAR, w)) - 1, "distance_52w_low": F.try_divide(F.col("close"), full(F.min, F.col("close"), YEAR, w)) - 1}


def against_market(w) -> dict[str, Column]:
    """Needs market_close (the benchmark's close on the row's date)."""
    m = F.col("market_close")
    out = {f"spy_return_{n}d": change(m, n, w) for n in (1, 5, 20)}
    out |= {f"excess_return_{n}d": change(F.col("close"), n, w) - change(m, n, w) for n in (5, 20)}
    return out | {f"relative_momentum_spy_{n}d": change(F.col("close"), n, w) - change(m, n, w) for n in (5, 20, 60)}


def co_movement(w) -> dict[str, Column]:
    """Needs return_1d and spy_return_1d."""
    r, m = F.col("return_1d"), F.col("spy_return_1d")
    return {f"correlation_spy_{n}d": rolling_correlation(r, m, n, w) for n in (20, 60)} | {f"beta_{n}d": rolling_beta(r, m, n, w) for n in (20, 60)}


def add_smoothed(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return per_series(df, keys or ["ticker"], SMOOTHED, smoothed)


def add_percentiles(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Place of today's value in its trailing year, ties at their middle. Needs volatility_20d."""
    return per_series(df, keys or ["ticker"], RANKED, ranked)


#: Bars before a row that its window features can look at: 252 volatilities of 20 returns.
LOOKBACK = 272


def windowed(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """df with every feature that looks back LOOKBACK bars at most, but for the percentiles; market_close is needed."""
    w = window(keys)
    for group in (returns, momentum, gaps, true_range, moving_averages, volumes, drawdowns, year_range, against_market):
        df = df.withColumns(group(w))
    for group in (volatility, downside_volatility, average_true_range, co_movement):
        df = df.withColumns(group(w))
    return df


def all_features(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """df with every feature; market_close is needed. keys tell the series apart (ticker, or ticker and segment)."""
    return per_series(windowed(df, keys), keys or ["ticker"], SMOOTHED | RANKED, smoothed_and_ranked)


def eligibility(df: DataFrame) -> DataFrame:
    """history flags and model_eligible from history_count and the essential features."""
    df = df.withColumns({f"has_{n}d_history": F.col("history_count") >= n for n in (20, 60, 120, 252)})
    complete = F.lit(True)
    for name in ESSENTIAL:
        complete = complete & F.col(name).isNotNull()
    return df.withColumn("model_eligible", (F.col("history_count") > YEAR) & complete)
