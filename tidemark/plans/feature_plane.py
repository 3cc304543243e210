"""Window features W1-W18 over the derived bars, and the eligibility flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import asof
from tidemark.operators import features as feature
from tidemark.plans import base


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.bars(spark, sf_dir).drop("available_at")


def _with_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    market = base.market(spark, sf_dir).select("trading_date", F.col("close").alias("market_close"))
    return _bars(spark, sf_dir).join(market, "trading_date", "left")


def _out(df: DataFrame, names, digits: int = 6) -> DataFrame:
    return df.select("ticker", "trading_date", *[F.round(n, digits).alias(n) for n in names])


def _query(*groups, market: bool = False, digits: int = 6):
    """A query of the last group's columns; the earlier groups provide what it needs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _with_market(spark, sf_dir) if market else _bars(spark, sf_dir)
        w = feature.window()
        for group in groups[:-1]:
            df = df.withColumns(group(w))
        last = groups[-1](w)
        return _out(df.withColumns(last), list(last), digits)

    return run


def w06_w13_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(feature.add_smoothed(_bars(spark, sf_dir)), list(feature.SMOOTHED))


def p06_feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features with eligibility, one row for each ticker and session."""
    df = feature.all_features(_with_market(spark, sf_dir))
    df = df.withColumn("history_count", F.count(F.lit(1)).over(Window.partitionBy("ticker").orderBy("trading_date")))
    df = feature.eligibility(df)
    return df.select("ticker", "trading_date", "history_count", "has_252d_history", "model_eligible", *[F.round(c, 6).alias(c) for c in feature.ESSENTIAL])


def w15_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = feature.window()
    df = _bars(spark, sf_dir).withColumns(feature.returns(w)).withColumns(feature.volatility(w))
    return _out(feature.add_percentiles(df.select("ticker", "trading_date", "close", "volume", "volatility_20d")), list(feature.RANKED))


def f07_history_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _bars(spark, sf_dir).withColumn("history_count", F.count(F.lit(1)).over(Window.partitionBy("ticker").orderBy("trading_date")))
    return df.select("ticker", "trading_date", "history_count", *[(F.col("history_count") >= n).alias(f"has_{n}d_history") for n in (20, 60, 120, 252)])


def w26_discontinuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions whose one-day move exceeds 30 percent, beside the move of the opens as the provider's; some closes are missing."""
    close = F.when(F.dayofmonth("trading_date") != 17, F.col("close"))
    df = _bars(spark, sf_dir).select("ticker", "trading_date", close.alias("split_adjusted_close"), F.col("open").alias("adjusted_close"))
    return _out(asof.discontinuities(df), ["internal_return_1d", "provider_adjusted_return_1d"])


QUERIES = {
    "w01_returns": _query(feature.returns),
    "w02_momentum": _query(feature.momentum),
    "w03_volatility": _query(feature.returns, feature.volatility),
    "w04_downside_volatility": _query(feature.returns, feature.downside_volatility),
    "w05_gaps": _query(feature.gaps),
    "w06_w13_rsi_macd": w06_w13_smoothed,
    "w07_true_range": _query(feature.true_range, feature.average_true_range),
    "w08_moving_averages": _query(feature.moving_averages),
    "w09_w11_volumes": _query(feature.volumes, digits=4),
    "w12_drawdowns": _query(feature.drawdowns),
    "w14_year_range": _query(feature.year_range),
    "w15_percentiles": w15_percentiles,
    "w16_j04_against_market": _query(feature.against_market, market=True),
    "w17_w18_co_movement": _query(feature.returns, feature.against_market, feature.co_movement, market=True),
    "w26_discontinuity": w26_discontinuity,
    "f07_history_flags": f07_history_flags,
    "p06_feature_rows": p06_feature_rows,
}

_W = "over (partition by ticker order by trading_date)"


def _frame(n: int) -> str:
    return f"over (partition by ticker order by trading_date rows between {n - 1} preceding and current row)"


def _change(x: str, n: int) -> str:
    return f"{x} / lag({x}, {n}) {_W} - 1"


def _rolling(aggregate: str, x: str, n: int) -> str:
    return f"case when count({x}) {_frame(n)} = {n} then {aggregate}({x}) {_frame(n)} end"


def _select(columns: dict[str, str], source: str = "bars", extra: str = "", digits: int = 6) -> str:
    listed = ", ".join(f"round({x}, {digits}) as {n}" for n, x in columns.items())
    return base.sql(f"select ticker, trading_date, {listed} from {source}", extra)


_R = f"r as (select *, {_change('close', 1)} as r1 from bars)"
_RV = _R + f", v as (select *, {_rolling('stddev_samp', 'r1', 20)} * sqrt(252) as v20 from r)"
_M = "m as (select b.*, k.close as mc from bars b left join market k using (trading_date))"
_MR = _M + f", mr as (select *, {_change('close', 1)} as r1, {_change('mc', 1)} as m1 from m)"


def _percentile(x: str) -> str:
    held = f"list({x}) {_frame(252)}"
    return f"case when count({x}) {_frame(252)} = 252 then (len(list_filter({held}, lambda v: v < {x})) + (len(list_filter({held}, lambda v: v = {x})) - 1) / 2.0) / 251.0 end"


def _pairs(n: int) -> tuple[str, str, str]:
    a, b = "case when m1 is not null then r1 end", "case when r1 is not null then m1 end"
    return a, b, f"count({a}) {_frame(n)} = {n}"


def _correlation(n: int) -> str:
    a, b, there = _pairs(n)
    return f"case when {there} and stddev_pop({a}) {_frame(n)} * stddev_pop({b}) {_frame(n)} > 0 then covar_pop({a}, {b}) {_frame(n)} / (stddev_pop({a}) {_frame(n)} * stddev_pop({b}) {_frame(n)}) end"


def _beta(n: int) -> str:
    a, b, there = _pairs(n)
    return f"case when {there} and var_samp({b}) {_frame(n)} > 0 then covar_samp({a}, {b}) {_frame(n)} / var_samp({b}) {_frame(n)} end"


_TR = f"r as (select *, greatest(high - low, abs(high - lag(close) {_W}), abs(low - lag(close) {_W})) as tr from bars)"
_LOSS = _R + ", d as (select *, coalesce(least(r1, 0), 0) as loss from r)"

ORACLES = {
    "w01_returns": _select({f"return_{n}d": _change("close", n) for n in (1, 2, 5, 10, 20, 60)}),
    "w02_momentum": _select({f"momentum_{n}d": _change("close", n) for n in (5, 10, 20, 60, 120)}),
    "w03_volatility": _select({f"volatility_{n}d": f"{_rolling('stddev_samp', 'r1', n)} * sqrt(252)" for n in (5, 10, 20, 60)}, "r", _R),
    "w04_downside_volatility": _select({"downside_volatility": f"case when count(*) {_frame(20)} = 20 then sqrt(avg(loss * loss) {_frame(20)}) * sqrt(252) end"}, "d", _LOSS),
    "w05_gaps": _select({"gap_open": f"open / lag(close) {_W} - 1", "overnight_return": f"open / lag(close) {_W} - 1", "intraday_return": "close / open - 1"}),
    "w07_true_range": _select({"atr_14": _rolling("avg", "tr", 14), "atr_pct": f"({_rolling('avg', 'tr', 14)}) / close"}, "r", _TR),
    "w08_moving_averages": _select({f"distance_ma{n}": f"(close - ({_rolling('avg', 'close', n)})) / ({_rolling('avg', 'close', n)})" for n in (10, 20, 50, 200)}),
    "w09_w11_volumes": _select({f"volume_ratio_{n}d": f"volume / ({_rolling('avg', 'volume', n)})" for n in (5, 20)} | {"volume_change_1d": _change("volume", 1)} | {f"avg_dollar_volume_{n}d": _rolling("avg", "(close * volume)", n) for n in (20, 60)}, digits=4),
    "w12_drawdowns": _select({f"max_drawdown_{n}d": f"case when count(close) {_frame(n)} = {n} then list_min(list_transform(range(1, {n + 1}), lambda i: l{n}[i] / list_max(l{n}[1:i]) - 1)) end" for n in (20, 60)}, "held", f"held as (select *, list(close) {_frame(20)} as l20, list(close) {_frame(60)} as l60 from bars)"),
    "w15_percentiles": _select({"percentile_price_252d": _percentile("close"), "percentile_volume_252d": _percentile("volume"), "percentile_volatility_252d": _percentile("v20")}, "v", _RV),
    "w14_year_range": _select({"distance_52w_high": f"close / ({_rolling('max', 'close', 252)}) - 1", "distance_52w_low": f"close / ({_rolling('min', 'close', 252)}) - 1"}),
    "w16_j04_against_market": _select({f"spy_return_{n}d": _change("mc", n) for n in (1, 5, 20)} | {f"excess_return_{n}d": f"({_change('close', n)}) - ({_change('mc', n)})" for n in (5, 20)} | {f"relative_momentum_spy_{n}d": f"({_change('close', n)}) - ({_change('mc', n)})" for n in (5, 20, 60)}, "m", _M),
    "w17_w18_co_movement": _select({f"correlation_spy_{n}d": _correlation(n) for n in (20, 60)} | {f"beta_{n}d": _beta(n) for n in (20, 60)}, "mr", _MR),
    "w26_discontinuity": base.sql(
        f"select ticker, trading_date, round(a, 6) as internal_return_1d, round(b, 6) as provider_adjusted_return_1d from (select ticker, trading_date, x / lag(x) {_W} - 1 as a, open / lag(open) {_W} - 1 as b from filled) where abs(a) > 0.30",
        f"filled as (select ticker, trading_date, open, last_value(case when dayofmonth(trading_date) <> 17 then close end ignore nulls) {_W} as x from bars)",
    ),
    "f07_history_flags": base.sql(f"select ticker, trading_date, count(*) {_W} as history_count, " + ", ".join(f"count(*) {_W} >= {n} as has_{n}d_history" for n in (20, 60, 120, 252)) + " from bars"),
}
