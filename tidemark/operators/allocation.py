"""Strategies, risk limits and ledgers' reports around the session simulation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import is_dividend


def finite(name: str):
    x = F.col(name)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def equal_weight(features: DataFrame) -> DataFrame:
    """(decision_date, ticker, weight): 1/n over each date's eligible names."""
    rows = features.where(F.coalesce("model_eligible", F.lit(False)))
    return rows.select("decision_date", "ticker", (F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy("decision_date"))).alias("weight"))


def momentum_top(features: DataFrame, k: int = 10, weight: float = 0.10, score: str = "momentum_20d") -> DataFrame:
    """The k eligible names with the highest finite momentum, ties by ticker, at a fixed weight; the rest is cash."""
    rows = features.where(F.coalesce("model_eligible", F.lit(False)) & finite(score))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("decision_date").orderBy(F.desc(score), "ticker")))
    return ranked.where(F.col("rank") <= k).select("decision_date", "ticker", "rank", F.col(score), F.lit(weight).alias("weight"))


def cash(allocations: DataFrame, days: DataFrame) -> DataFrame:
    """(decision_date, assets, cash_weight) of every day, all cash where nothing is allocated."""
    held = allocations.groupBy("decision_date").agg(F.count(F.lit(1)).alias("assets"), F.sum("weight").alias("_w"))
    return days.join(held, "decision_date", "left").select("decision_date", F.coalesce("assets", F.lit(0)).alias("assets"), (1 - F.coalesce("_w", F.lit(0.0))).alias("cash_weight"))


def buy_and_hold_days(calendar: DataFrame, actions: DataFrame) -> DataFrame:
    """Decision days of a buy-and-hold: the first session and the sessions with a dividend."""
    first = calendar.agg(F.min("session").alias("decision_date"))
    paid = actions.where(is_dividend()).select(F.col("effective_date").alias("session")).distinct().join(calendar, "session").select(F.col("session").alias("decision_date"))
    return first.unionByName(paid).distinct()


def risk_check(weights: DataFrame, key: str = "decision_date", max_weight: float = 0.10, max_positions: int = 15, max_exposure: float = 1.0) -> DataFrame:
    """(key, ticker, weight, action, approved): shorts, too many names or too much exposure block; large weights are capped."""
    w = Window.partitionBy(key)
    long = F.col("weight") > 0
    capped = F.least(F.col("weight"), F.lit(max_weight))
    short = F.max((F.col("weight") < 0).cast("int")).over(w) == 1
    crowded = F.count(F.when(long, 1)).over(w) > max_positions
    heavy = F.round(F.sum(F.when(long, capped)).over(w), 9) > max_exposure
    cut = F.max((F.col("weight") > max_weight).cast("int")).over(w) == 1
    action = F.when(short | crowded | heavy, "BLOCK").when(cut, "REDUCE").otherwise("APPROVE")
    return weights.withColumn("action", action).withColumn("approved", F.when((F.col("action") != "BLOCK") & long, capped))


def execution_report(executions: DataFrame, orders: DataFrame) -> DataFrame:
    """Counts and rates of execution statuses, and orders without a record."""
    pending = orders.join(executions.select("order_id"), "order_id", "left_anti").agg(F.count(F.lit(1)).alias("pending_orders"))
    n = F.count(F.lit(1))
    counts = executions.agg(n.alias("records"), *[F.count_if(F.col("status") == s).alias(f"{s}_orders") for s in ("filled", "partially_filled", "unfilled")])
    rates = {f"{s}_rate": F.try_divide(F.col(f"{s}_orders"), F.col("records")) for s in ("filled", "partially_filled", "unfilled")}
    return counts.withColumns(rates).crossJoin(F.broadcast(pending))


def turnover(fills: DataFrame, nav: DataFrame) -> DataFrame:
    """Traded notional of each session over its NAV: total, mean and annualised; days without trades count."""
    daily = fills.groupBy("session").agg(F.sum("notional").alias("traded"))
    rate = nav.join(daily, "session", "left").select(F.try_divide(F.coalesce("traded", F.lit(0.0)), F.col("nav")).alias("t"))
    return rate.agg(F.sum("t").alias("total_turnover"), F.avg("t").alias("average_daily_turnover"), (F.avg("t") * 252).alias("annualized_turnover"))


def unmatched_fills(fills: DataFrame, nav: DataFrame) -> DataFrame:
    """Fill sessions without a snapshot; must be empty."""
    return fills.select("session").distinct().join(nav.select("session"), "session", "left_anti")
