"""Window helpers: frames that count only when full, average-tie ranks, safe correlations, recurrences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_time(keys: list[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def full(aggregate: Callable[[Column], Column], value: Column, size: int, window: WindowSpec) -> Column:
    """Aggregate of the last size rows, null unless all of them have a value."""
    frame = window.rowsBetween(-(size - 1), 0)
    return F.when(F.count(value).over(frame) == size, aggregate(value).over(frame))


def change(value: Column, lag: int, window: WindowSpec) -> Column:
    """value / its value lag rows before - 1, null where that is 0."""
    return F.try_divide(value, F.lag(value, lag).over(window)) - 1


def average_rank(value: Column, keys: list, ascending: bool = True) -> Column:
    """Rank from 1 with ties sharing the average of their places."""
    order = value.asc() if ascending else value.desc()
    return F.rank().over(Window.partitionBy(*keys).orderBy(order)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2


def percentile_rank(value: Column, keys: list, least: int = 2) -> Column:
    """(average rank - 1) / (n - 1) over the non-null values of keys; null for fewer than least."""
    there = value.isNotNull()
    count = F.count(value).over(Window.partitionBy(*keys))
    rank = average_rank(value, [*keys, there])
    return F.when(there & (count >= least), F.try_divide(rank - 1, count - 1))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; null for constant or fewer than two pairs."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def rolling_correlation(x: Column, y: Column, size: int, window: WindowSpec) -> Column:
    """Correlation of the last size pairs, null unless all are there and neither side is constant."""
    frame = window.rowsBetween(-(size - 1), 0)
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(a).over(frame) * F.stddev_pop(b).over(frame)
    return F.when(F.count(a).over(frame) == size, F.try_divide(F.covar_pop(a, b).over(frame), spread))


def rolling_beta(x: Column, y: Column, size: int, window: WindowSpec) -> Column:
    """Sample covariance of x and y over the sample variance of y, for full frames."""
    frame = window.rowsBetween(-(size - 1), 0)
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.when(F.count(a).over(frame) == size, F.try_divide(F.covar_samp(a, b).over(frame), F.var_samp(b).over(frame)))


def per_series(df: DataFrame, keys: list[str], columns: dict[str, str], function) -> DataFrame:
    """Add columns (name -> type) that a function of one series, sorted by time, computes in pandas.

    For recurrences, which no window frame expresses. A series is one key's history, a few thousand rows.
    """
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{n}` {t}" for n, t in columns.items()])
    return df.groupBy(*keys).applyInPandas(function, schema)
