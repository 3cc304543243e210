"""Metrics, strategies, risk and backtests over the derived relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import allocation, backtest, metrics
from tidemark.operators.asof import split_adjusted
from tidemark.operators.windows import change, percentile_rank
from tidemark.plans import base

_W = Window.partitionBy


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score: 5-day momentum; actual: the next session's return."""
    w = Window.partitionBy("ticker").orderBy("trading_date")
    bars = base.bars(spark, sf_dir)
    return bars.select("ticker", F.col("trading_date").alias("decision_date"), change(F.col("close"), 5, w).alias("score"), (F.lead("close").over(w) / F.col("close") - 1).alias("actual")).where("score is not null and actual is not null")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def a04_daily_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.daily_correlation(_scores(spark, sf_dir), "actual", "score"))


def a05_w21_rank_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = metrics.daily_correlation(_scores(spark, sf_dir), "actual", "score", method="spearman")
    return _rounded(metrics.ic_summary(_rounded(daily, 9)))


def a06_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.top_k(_scores(spark, sf_dir), "actual", "score", 5))


def a07_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.regression_errors(_scores(spark, sf_dir), "actual", "score"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.read(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return base.read(spark, sf_dir, "labels").join(docs, "doc_id").withColumn("p", F.pmod("n_chars", F.lit(97)) / 96.0)


def a08_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.classification(_labelled(spark, sf_dir), "quality", "p"))


def a21_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.confusion(_labelled(spark, sf_dir), F.col("quality") == 1, F.col("p") >= 0.3))


def a22_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).withColumn("predicted", F.when(F.col("p") < 0.33, "low").when(F.col("p") < 0.66, "mid").otherwise("high"))
    return rows.groupBy("quality").pivot("predicted", ["low", "mid", "high"]).count().na.fill(0, ["low", "mid", "high"])


def a20_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.stability(metrics.daily_correlation(_scores(spark, sf_dir), "actual", "score")))


def w20_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _scores(spark, sf_dir).withColumn("percentile", percentile_rank(F.col("score"), ["decision_date"]))
    return _rounded(df.select("ticker", "decision_date", "percentile"))


def t06_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of lags within 0.01 of the best mean correlation, the shortest."""
    w = Window.partitionBy("ticker").orderBy("trading_date")
    bars = base.bars(spark, sf_dir)
    out = None
    for lag in (1, 5, 20):
        rows = bars.select("ticker", F.col("trading_date").alias("decision_date"), change(F.col("close"), lag, w).alias("score"), (F.lead("close").over(w) / F.col("close") - 1).alias("actual"))
        one = metrics.daily_correlation(rows, "actual", "score").agg(F.round(F.avg("ic"), 6).alias("mean_ic")).withColumn("lag", F.lit(lag))
        out = one if out is None else out.unionByName(one)
    return metrics.select_best(out, "mean_ic", 0.01, [F.col("lag")])


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy("trading_date")
    n = F.count(F.lit(1)).over(w)
    return base.bars(spark, sf_dir).select("ticker", F.col("trading_date").alias("decision_date"), F.round(change(F.col("close"), 20, w), 9).alias("momentum_20d"), (n > 60).alias("model_eligible"))


def b01_equal_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = allocation.equal_weight(_features(spark, sf_dir))
    days = base.calendar(spark, sf_dir).select(F.col("session").alias("decision_date"))
    return _rounded(allocation.cash(df, days))


def t02_momentum_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = allocation.momentum_top(_features(spark, sf_dir))
    return df.select("decision_date", "ticker", "rank", F.round("momentum_20d", 6).alias("momentum_20d"), "weight")


def b03_buy_and_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allocation.buy_and_hold_days(base.calendar(spark, sf_dir), base.actions(spark, sf_dir))


def b14_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    # whole billionths, so that every engine sums the same weights
    shares = base.bars(spark, sf_dir).withColumn("weight", F.expr("(cast(volume as bigint) * 1000000000) div cast(sum(volume) over (partition by trading_date) as bigint)") / 1e9)
    checked = allocation.risk_check(shares.select(F.col("trading_date").alias("decision_date"), "ticker", "weight"))
    return checked.groupBy("decision_date").agg(F.max("action").alias("action"), F.round(F.sum("approved"), 9).alias("exposure"))


def _inputs(spark: SparkSession, sf_dir: str, benchmark: str | None = None) -> DataFrame:
    """Simulation rows of both strategies, and of a name that is held as the benchmark."""
    features = _features(spark, sf_dir)
    day = F.dayofmonth("decision_date") == 1
    plans = [("equal_weight", allocation.equal_weight(features)), ("momentum_top", allocation.momentum_top(features).drop("rank", "momentum_20d"))]
    targets = None
    for name, plan in plans:
        part = plan.where(day).select(F.lit(name).alias("run_id"), "decision_date", "ticker", "weight")
        targets = part if targets is None else targets.unionByName(part)
    if benchmark:
        own = base.bars(spark, sf_dir).where(F.col("ticker") == benchmark).select(F.col("trading_date").alias("session"))
        days = allocation.buy_and_hold_days(own, base.actions(spark, sf_dir).where(F.col("ticker") == benchmark))
        targets = targets.unionByName(days.select(F.lit("benchmark").alias("run_id"), "decision_date", F.lit(benchmark).alias("ticker"), F.lit(1.0).alias("weight")))
    calendar = base.calendar(spark, sf_dir).select("session")
    bars = base.bars(spark, sf_dir)
    every = bars.select("ticker").distinct().crossJoin(F.broadcast(calendar.withColumnRenamed("session", "trading_date")))
    filled = every.join(bars, ["ticker", "trading_date"], "left")
    known = Window.partitionBy("ticker").orderBy("trading_date").rowsBetween(Window.unboundedPreceding, 0)
    filled = filled.withColumns({"close": F.last("close", ignorenulls=True).over(known), "open": F.coalesce("open", F.last("close", ignorenulls=True).over(known))})
    runs = targets.select("run_id").distinct()
    actions = base.actions(spark, sf_dir)
    return backtest.inputs(runs, calendar, filled, actions, targets)


def _runs(spark: SparkSession, sf_dir: str, benchmark: str | None = None) -> DataFrame:
    return backtest.run_all(_inputs(spark, sf_dir, benchmark))


def b04_b13_backtests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two strategies side by side: records by kind and status."""
    return _runs(spark, sf_dir).groupBy("run_id", "record", "status").agg(F.count(F.lit(1)).alias("records"), F.round(F.sum("notional"), 2).alias("notional"))


def b11_w22_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    nav = _runs(spark, sf_dir).where("record = 'snapshot'").select("run_id", F.col("session").alias("as_of"), "nav")
    return _rounded(metrics.portfolio(nav, ["run_id"]))


def a14_turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _runs(spark, sf_dir).where("run_id = 'equal_weight'")
    nav = records.where("record = 'snapshot'").select("session", "nav")
    return _rounded(allocation.turnover(records.where("record = 'execution' and quantity > 0"), nav))


def b11_market_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Performance and drawdown lifecycle of each nation's split-adjusted close, as a NAV."""
    nav = split_adjusted(base.bars(spark, sf_dir), base.actions(spark, sf_dir)).select("ticker", F.col("trading_date").alias("as_of"), F.col("split_adjusted_close").alias("nav"))
    return _rounded(metrics.portfolio(nav, ["ticker"]))


QUERIES = {
    "a04_daily_ic": a04_daily_ic,
    "a05_w21_rank_ic": a05_w21_rank_ic,
    "a06_t03_top_k": a06_top_k,
    "a07_regression_errors": a07_regression,
    "a08_classification": a08_classification,
    "a20_stability": a20_stability,
    "a21_confusion": a21_confusion,
    "a22_confusion_matrix": a22_confusion_matrix,
    "w20_percentile": w20_percentile,
    "t06_select": t06_select,
    "t02_momentum_top10": t02_momentum_top10,
    "b01_equal_weight": b01_equal_weight,
    "b03_buy_and_hold": b03_buy_and_hold,
    "b14_risk": b14_risk,
    "b04_b13_backtests": b04_b13_backtests,
    "b11_w22_performance": b11_w22_performance,
    "b11_drawdowns": b11_market_performance,
    "a14_turnover": a14_turnover,
}

_T = "over (partition by ticker order by trading_date)"
_S = f"scores as (select * from (select ticker, trading_date as decision_date, close / lag(close, 5) {_T} - 1 as score, lead(close) {_T} / close - 1 as actual from bars) where score is not null and actual is not null)"
_RANKS = _S + ", ranked as (select decision_date, rank() over (partition by decision_date order by score) + (count(*) over (partition by decision_date, score) - 1) / 2.0 as score, rank() over (partition by decision_date order by actual) + (count(*) over (partition by decision_date, actual) - 1) / 2.0 as actual from scores)"
_CORR = "select decision_date, covar_pop(actual, score) / (stddev_pop(actual) * stddev_pop(score)) as ic from {} group by 1 having count(distinct actual) > 1 and count(distinct score) > 1 and stddev_pop(actual) * stddev_pop(score) > 0"
_F = f"features as (select ticker, trading_date as decision_date, round(close / lag(close, 20) {_T} - 1, 9) as momentum_20d, count(*) {_T} > 60 as ok from bars)"
_L = "with l as (select quality, (n_chars % 97) / 96.0 as p from labels join documents using (doc_id)) "

ORACLES = {
    "a04_daily_ic": base.sql(f"select decision_date, round(ic, 6) as ic from ({_CORR.format('scores')})", _S),
    "a05_w21_rank_ic": base.sql(f"select count(*) as days, round(avg(ic), 6) as mean, round(median(ic), 6) as median, round(stddev_samp(ic), 6) as std, round(avg(ic) / stddev_samp(ic), 6) as icir, round(avg(cast(ic > 0 as integer)), 6) as pct_positive from (select round(ic, 9) as ic from ({_CORR.format('ranked')}))", _RANKS),
    "a06_t03_top_k": base.sql("select count(*) as dates, round(avg(top), 6) as average_top_return, round(avg(uni), 6) as average_universe_return, round(avg(top - uni), 6) as average_uplift, round(avg(cast(top > uni as integer)), 6) as pct_dates_positive_uplift from (select decision_date, avg(case when n <= 5 then actual end) as top, avg(actual) as uni from (select *, row_number() over (partition by decision_date order by score desc, ticker) as n from scores) group by 1 having count(*) >= 5 and count(distinct score) > 1)", _S),
    "a07_regression_errors": base.sql("select round(avg(abs(actual - score)), 6) as mae, round(sqrt(avg((actual - score) * (actual - score))), 6) as rmse, round(covar_pop(actual, score) / (stddev_pop(actual) * stddev_pop(score)), 6) as pearson from scores", _S),
    "a08_classification": _L + "select count(*) as rows, round(avg(quality), 6) as positive_prevalence, round(avg(-case when quality = 1 then ln(greatest(least(p, 1 - 2.220446049250313e-16), 2.220446049250313e-16)) else ln(1 - greatest(least(p, 1 - 2.220446049250313e-16), 2.220446049250313e-16)) end), 6) as log_loss, round((select sum(case when a.p > b.p then 1.0 when a.p = b.p then 0.5 else 0 end) / count(*) from l a, l b where a.quality = 1 and b.quality = 0), 6) as roc_auc, round((sum(case when quality = 1 and p >= 0.5 then 1.0 else 0 end) / sum(quality) + sum(case when quality = 0 and p < 0.5 then 1.0 else 0 end) / sum(1 - quality)) / 2, 6) as balanced_accuracy from l",
    "a20_stability": base.sql(f"select round(min(m), 6) as worst, min_by(y, m) as worst_year, round(max(m), 6) as best, round(stddev_samp(m), 6) as std, count(case when m > 0 then 1 end) as positive_years, count(case when m <= 0 then 1 end) as other_years from (select year(decision_date) as y, avg(ic) as m from ({_CORR.format('scores')}) group by 1)", _S),
    "a21_confusion": _L + "select *, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * tp / (2 * tp + fp + fn), 6) as f1 from (select count(case when quality = 1 and p >= 0.3 then 1 end) as tp, count(case when quality = 0 and p >= 0.3 then 1 end) as fp, count(case when quality = 1 and p < 0.3 then 1 end) as fn, count(case when quality = 0 and p < 0.3 then 1 end) as tn from l)",
    "a22_confusion_matrix": _L + "select quality, count(case when p < 0.33 then 1 end) as low, count(case when p >= 0.33 and p < 0.66 then 1 end) as mid, count(case when p >= 0.66 then 1 end) as high from l group by 1",
    "w20_percentile": base.sql("select ticker, decision_date, round(case when n >= 2 then (rk + (ties - 1) / 2.0 - 1) / (n - 1) end, 6) as percentile from (select *, rank() over (partition by decision_date order by score) as rk, count(*) over (partition by decision_date, score) as ties, count(*) over (partition by decision_date) as n from scores)", _S),
    "t02_momentum_top10": base.sql("select decision_date, ticker, cast(n as integer) as rank, round(momentum_20d, 6) as momentum_20d, 0.1 as weight from (select *, row_number() over (partition by decision_date order by momentum_20d desc, ticker) as n from features where ok and momentum_20d is not null) where n <= 10", _F),
    "b01_equal_weight": base.sql("select session as decision_date, count(f.ticker) as assets, round(1 - case when count(f.ticker) > 0 then 1.0 else 0.0 end, 6) as cash_weight from calendar left join (select * from features where ok) f on f.decision_date = session group by 1", _F),
    "b03_buy_and_hold": base.sql("select min(session) as decision_date from calendar union select distinct effective_date from actions join calendar on session = effective_date where action_type like '%dividend'"),
    "b14_risk": base.sql("select decision_date, case when count(*) > 15 then 'BLOCK' when max(w) > 0.1 then case when round(sum(least(w, 0.1)), 9) > 1 then 'BLOCK' else 'REDUCE' end when round(sum(w), 9) > 1 then 'BLOCK' else 'APPROVE' end as action, round(case when count(*) <= 15 and round(sum(least(w, 0.1)), 9) <= 1 then sum(least(w, 0.1)) end, 9) as exposure from (select trading_date as decision_date, ticker, (cast(volume as bigint) * 1000000000 // cast(sum(volume) over (partition by trading_date) as bigint)) / 1e9 as w from bars) group by 1"),
}
