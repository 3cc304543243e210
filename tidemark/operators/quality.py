"""Data-quality queries over bars, features and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.sizes import small


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def price_violations(bars: DataFrame) -> DataFrame:
    """Bars whose high or low doesn't bound open and close, or with a price or volume out of range."""
    bad = (F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high")) | (F.least("open", "high", "low", "close") <= 0) | (F.col("volume") < 0)
    return bars.where(bad)


def session_gaps(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """(ticker, session) without a bar between a ticker's first and last; calendar has session and seq."""
    there = bars.select("ticker", F.col("trading_date").alias("session")).join(small(calendar), "session").select("ticker", "seq")
    spans = there.groupBy("ticker").agg(F.min("seq").alias("a"), F.max("seq").alias("b"))
    due = spans.select("ticker", F.explode(F.sequence("a", "b")).alias("seq")).join(there, ["ticker", "seq"], "left_anti")
    return due.join(small(calendar), "seq").select("ticker", "session")


def ticker_diagnostics(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("bars"), F.min("trading_date").alias("first_date"), F.max("trading_date").alias("last_date"), F.count_if(F.col("high") < F.col("low")).alias("inverted"), F.count_if(F.col("volume") <= 0).alias("without_volume"))


def coverage(rows: DataFrame, calendar: DataFrame, day: str = "decision_date") -> DataFrame:
    """Least, median, mean and most tickers of a session; sessions without rows count 0."""
    counts = rows.groupBy(F.col(day).alias("session")).agg(F.count_distinct("ticker").alias("n"))
    every = calendar.select("session").join(counts, "session", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return every.agg(F.min("n").alias("least"), F.percentile("n", F.lit(0.5)).alias("median"), F.avg("n").alias("mean"), F.max("n").alias("most"))


def column_health(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, null_share, least, most) of each column, in one pass and unpivoted."""
    sums = df.agg(*[x for c in columns for x in (F.avg(F.col(c).isNull().cast("double")).alias(f"{c}__n"), F.min(c).alias(f"{c}__a"), F.max(c).alias(f"{c}__b"))])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__n").alias("null_share"), F.col(f"{c}__a").cast("double").alias("least"), F.col(f"{c}__b").cast("double").alias("most")) for c in columns])
    return sums.select(F.inline(rows))


#: name -> (column, bound): a row is an outlier if the absolute value exceeds the bound.
OUTLIERS = {"return_1d": 0.30, "return_5d": 0.60, "volatility_20d": 1.5, "volume_ratio_20d": 10.0, "atr_pct": 0.25}


def outliers(features: DataFrame, day: str = "trading_date") -> DataFrame:
    """(ticker, day, rule, value) of the rows beyond the bounds."""
    rules = F.array(*[F.when(F.abs(F.col(c)) > b, F.struct(F.lit(c).alias("rule"), F.col(c).alias("value"))) for c, b in OUTLIERS.items() if c in features.columns])
    return features.select("ticker", day, F.inline(F.filter(rules, lambda r: r.isNotNull())))


def extremes(df: DataFrame, column: str, k: int = 25, ties: tuple = ("ticker", "trading_date")) -> DataFrame:
    """The k highest and the k lowest values."""
    rows = df.where(F.col(column).isNotNull())
    high = rows.orderBy(F.desc(column), *ties).limit(k).withColumn("side", F.lit("high"))
    return high.unionByName(rows.orderBy(F.asc(column), *ties).limit(k).withColumn("side", F.lit("low")))


def ranking_coverage(ranked: DataFrame, rank: str, day: str = "decision_date") -> DataFrame:
    """Ranked rows of each date, and why a date has none."""
    counts = ranked.groupBy(day).agg(F.count(F.lit(1)).alias("rows"), F.count(rank).alias("ranked"))
    return counts.withColumn("reason", F.when(F.col("ranked") == 0, "too_few_eligible"))


def rare_first(df: DataFrame, rare: Column, order: list, n: int, least: int) -> DataFrame:
    """A deterministic sample of n: up to least rows of the rare pool first, then the rest of both by order."""
    marked = df.withColumn("_rare", F.coalesce(rare, F.lit(False)))
    keys = [*order, "doc_id"]
    picked = marked.where("_rare").orderBy(*keys).limit(least).withColumn("_turn", F.lit(0))
    rest = marked.join(picked.select("doc_id"), "doc_id", "left_anti").withColumn("_turn", F.lit(1))
    return picked.unionByName(rest).orderBy("_turn", *keys).limit(n).drop("_rare", "_turn")


def round_robin(df: DataFrame, bucket: str, order: list, n: int) -> DataFrame:
    """A deterministic sample: the first of every bucket, then the second of every bucket, and so on."""
    ranked = df.withColumn("_turn", F.row_number().over(Window.partitionBy(bucket).orderBy(*order)))
    return ranked.orderBy("_turn", bucket).limit(n).drop("_turn")
