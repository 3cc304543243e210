"""Prediction, classification and portfolio metrics as aggregations."""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.windows import average_rank, correlation

YEAR = 252
DAYS_PER_YEAR = 365.25
NEAR_ZERO = 1e-15


def daily_correlation(df: DataFrame, actual: str, predicted: str, day: str = "decision_date", method: str = "pearson") -> DataFrame:
    """(day, ic): correlation of each date's cross-section; degenerate dates are left out."""
    pairs = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    x, y = F.col(actual).cast("double"), F.col(predicted).cast("double")
    if method == "spearman":
        pairs = pairs.withColumns({"_x": average_rank(x, [day]), "_y": average_rank(y, [day])})
        x, y = F.col("_x"), F.col("_y")
    out = pairs.groupBy(day).agg(correlation(x, y).alias("ic"), F.count_distinct(x).alias("_nx"), F.count_distinct(y).alias("_ny"))
    return out.where("_nx > 1 and _ny > 1 and ic is not null").select(day, "ic")


def ic_summary(daily: DataFrame, value: str = "ic") -> DataFrame:
    """days, mean, median, std, icir and pct_positive of daily correlations."""
    v = F.col(value)
    spread = F.stddev_samp(v)
    return daily.agg(
        F.count(v).alias("days"),
        F.avg(v).alias("mean"),
        F.percentile(v, F.lit(0.5)).alias("median"),
        spread.alias("std"),
        F.when(spread > 0, F.try_divide(F.avg(v), spread)).alias("icir"),
        F.avg((v > 0).cast("double")).alias("pct_positive"),
    )


def top_k(df: DataFrame, actual: str, score: str, k: int = 10, day: str = "decision_date", tie: str = "ticker") -> DataFrame:
    """Mean outcome of each date's k best scores against its universe; dates with fewer than k or one score are left out."""
    rows = df.where(F.col(actual).isNotNull() & F.col(score).isNotNull())
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(day).orderBy(F.desc(score), tie)))
    daily = ranked.groupBy(day).agg(F.count(F.lit(1)).alias("_size"), F.count_distinct(score).alias("_scores"), F.avg(F.when(F.col("_n") <= k, F.col(actual))).alias("top"), F.avg(actual).alias("universe"))
    daily = daily.where((F.col("_size") >= k) & (F.col("_scores") > 1)).withColumn("uplift", F.col("top") - F.col("universe"))
    return daily.agg(
        F.count(F.lit(1)).alias("dates"),
        F.avg("top").alias("average_top_return"),
        F.avg("universe").alias("average_universe_return"),
        F.avg("uplift").alias("average_uplift"),
        F.avg((F.col("uplift") > 0).cast("double")).alias("pct_dates_positive_uplift"),
    )


def regression_errors(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    error = F.col(actual) - F.col(predicted)
    return df.agg(F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), correlation(F.col(actual).cast("double"), F.col(predicted).cast("double")).alias("pearson"))


def classification(df: DataFrame, actual: str, probability: str) -> DataFrame:
    """rows, prevalence, log loss, ROC AUC (by average ranks) and balanced accuracy; the last two null for one class.

    The ranks come from the counts of each distinct probability, so no window over all rows is needed.
    """
    y, p = F.col(actual).cast("int"), F.least(F.greatest(F.col(probability), F.lit(2.220446049250313e-16)), F.lit(1 - 2.220446049250313e-16))
    loss = -F.when(y == 1, F.log(p)).otherwise(F.log(1 - p))
    hit = F.col(probability) >= 0.5
    totals = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(y).alias("positive_prevalence"),
        F.avg(loss).alias("log_loss"),
        F.sum(y).alias("_pos"),
        F.count_if((y == 1) & hit).alias("_tp"),
        F.count_if((y == 0) & ~hit).alias("_tn"),
    )
    by_value = df.groupBy(F.col(probability).alias("_p")).agg(F.sum(y).alias("_p1"), F.count_if(y == 0).alias("_p0"))
    below = F.sum("_p0").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    wins = by_value.select((F.col("_p1") * (F.coalesce(below, F.lit(0)) + F.col("_p0") / 2)).alias("_w")).agg(F.sum("_w").alias("_wins"))
    both = totals.crossJoin(F.broadcast(wins))  # one row each
    negative = F.col("rows") - F.col("_pos")
    two = (F.col("_pos") > 0) & (negative > 0)
    return both.select("rows", "positive_prevalence", "log_loss", F.when(two, F.try_divide(F.col("_wins"), F.col("_pos") * negative)).alias("roc_auc"), F.when(two, (F.try_divide(F.col("_tp"), F.col("_pos")) + F.try_divide(F.col("_tn"), negative)) / 2).alias("balanced_accuracy"))


def confusion(df: DataFrame, label: Column, prediction: Column) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and f1; null where a denominator is 0."""
    counts = df.agg(*[F.count_if(when).alias(n) for n, when in (("tp", label & prediction), ("fp", ~label & prediction), ("fn", label & ~prediction), ("tn", ~label & ~prediction))])
    return counts.withColumns({
        "precision": F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")),
        "recall": F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")),
        "f1": F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
    })


def portfolio(nav: DataFrame, keys: list[str]) -> DataFrame:
    """Performance of each key's NAV series (as_of date, nav): returns, volatility, Sharpe, Sortino, drawdown lifecycle."""
    w = Window.partitionBy(*keys).orderBy("as_of")
    top = F.max("nav").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = nav.withColumn("_r", F.try_divide(F.col("nav"), F.lag("nav").over(w)) - 1).withColumn("_dd", F.try_divide(F.col("nav"), top) - 1)
    r, loss = F.col("_r"), F.least(F.col("_r"), F.lit(0.0))
    spread, mean, fall = F.stddev_samp(r), F.avg(r), F.sqrt(F.avg(loss * loss))
    enough = F.count(r) >= 2
    growth = F.try_divide(F.max_by("nav", "as_of"), F.min_by("nav", "as_of"))
    days = F.date_diff(F.max("as_of"), F.min("as_of"))
    summary = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observations"),
        (growth - 1).alias("cumulative_return"),
        F.when(days > 0, F.pow(growth, DAYS_PER_YEAR / days) - 1).alias("cagr"),
        F.when(enough, spread * sqrt(YEAR)).alias("annualized_volatility"),
        F.when(enough & (spread > NEAR_ZERO), mean / spread * sqrt(YEAR)).alias("sharpe"),
        F.when(enough & (fall > NEAR_ZERO), mean * YEAR / (fall * sqrt(YEAR))).alias("sortino"),
        F.min("_dd").alias("max_drawdown"),
        F.min_by("as_of", F.struct("_dd", "as_of")).alias("trough_date"),
    )
    lows = summary.select(*keys, "trough_date")
    before = rows.join(lows, keys).where(F.col("as_of") <= F.col("trough_date")).groupBy(*keys, "trough_date").agg(F.min_by(F.struct("as_of", "nav"), F.struct(-F.col("nav"), "as_of")).alias("_peak"))
    after = rows.join(before, keys).where((F.col("as_of") > F.col("trough_date")) & (F.col("nav") >= F.col("_peak.nav"))).groupBy(*keys).agg(F.min("as_of").alias("recovery_date"))
    return summary.join(before.select(*keys, F.col("_peak.as_of").alias("peak_date")), keys).join(after, keys, "left")


def stability(daily: DataFrame, value: str = "ic", day: str = "decision_date") -> DataFrame:
    """Yearly means of a daily metric, and their worst, best, spread and signs."""
    yearly = daily.groupBy(F.year(day).alias("year")).agg(F.avg(value).alias("m"))
    return yearly.agg(F.min("m").alias("worst"), F.min_by("year", F.struct("m", "year")).alias("worst_year"), F.max("m").alias("best"), F.stddev_samp("m").alias("std"), F.count_if(F.col("m") > 0).alias("positive_years"), F.count_if(F.col("m") <= 0).alias("other_years"))


def select_best(candidates: DataFrame, metric: str, tolerance: float, simplest: list[Column]) -> DataFrame:
    """Of the candidates within tolerance of the best metric, the first by the simplicity order."""
    best = candidates.agg(F.max(metric).alias("_best"))
    near = candidates.crossJoin(F.broadcast(best)).where(F.col(metric) >= F.col("_best") - tolerance)
    return near.drop("_best").orderBy(*simplest).limit(1)
