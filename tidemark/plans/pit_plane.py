"""As-of filters, split factors, labels, ranks, purging and schedules over the derived relations."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import asof, targets
from tidemark.plans import base

DAY = date(1998, 6, 15)
LEAST = 10
SPLITS = {"train": (date(1995, 1, 1), date(1998, 12, 31)), "validation": (date(1999, 1, 1), date(1999, 12, 31)), "test": (date(2000, 1, 1), None)}


def f01_visible_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.lit(DAY)
    return asof.visible(base.bars(spark, sf_dir), "trading_date", day, asof.decision_time(day)).groupBy("ticker").agg(F.count(F.lit(1)).alias("bars"), F.max("trading_date").alias("last_date"))


def f02_visible_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.lit(DAY)
    return asof.visible(base.actions(spark, sf_dir).where(asof.is_split()), "effective_date", day, asof.decision_time(day)).select("ticker", "effective_date", "split_factor")


def f03_action_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base.actions(spark, sf_dir).groupBy("ticker").agg(F.count_if(asof.is_split()).alias("splits"), F.count_if(asof.is_dividend()).alias("dividends"))


def p01_extract_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions re-extracted from bars that carry them as columns."""
    own = base.actions(spark, sf_dir).groupBy("ticker", F.col("effective_date").alias("trading_date")).agg(F.max("split_factor").alias("split_factor"), F.max("dividend_cash").alias("dividend_cash"))
    bars = base.bars(spark, sf_dir).join(own, ["ticker", "trading_date"], "left").withColumns({"split_factor": F.coalesce("split_factor", F.lit(1.0)), "dividend_cash": F.coalesce("dividend_cash", F.lit(0.0))})
    return asof.extract_actions(bars).select("ticker", "effective_date", "action_type", "split_factor", "dividend_cash")


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.split_adjusted(base.bars(spark, sf_dir), base.actions(spark, sf_dir))


def p02_latest_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _latest(spark, sf_dir)
    return df.select("ticker", "trading_date", F.col("cumulative_future_split_factor").alias("factor"), "split_adjusted_close", "split_adjusted_volume")


def p03_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = asof.split_adjusted_as_of(base.bars(spark, sf_dir), base.actions(spark, sf_dir), F.lit(DAY))
    return df.select("ticker", "trading_date", F.col("cumulative_future_split_factor").alias("factor"), "split_adjusted_close")


def j07_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.segments(base.bars(spark, sf_dir), base.actions(spark, sf_dir), base.calendar(spark, sf_dir))


def p04_segment_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20-day momentum of every decision day on the basis that was known that day."""
    history = asof.segment_histories(base.bars(spark, sf_dir), base.actions(spark, sf_dir), base.calendar(spark, sf_dir))
    w = Window.partitionBy("ticker", "first_seq").orderBy("trading_date")
    lagged = history.withColumn("momentum_20d", F.try_divide(F.col("split_adjusted_close"), F.lag("split_adjusted_close", 20).over(w)) - 1)
    return lagged.where("bar_seq between first_seq and last_seq").select("ticker", "trading_date", "first_seq", F.round("split_adjusted_close", 6).alias("split_adjusted_close"), F.round("momentum_20d", 6).alias("momentum_20d"))


def a03_history_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars known by each session's cutoff, counted once by activation."""
    calendar = base.calendar(spark, sf_dir)
    active = asof.activation(base.bars(spark, sf_dir), "trading_date", calendar).groupBy("ticker", "active_seq").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("ticker").orderBy("active_seq"))
    return active.select("ticker", "active_seq", total.alias("history_count"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = base.bars(spark, sf_dir).withColumns({"split_adjusted_close": F.col("close"), "adjusted_close": F.col("open")})
    return asof.detect_events(bars, base.actions(spark, sf_dir), 0.30)


def p10_detect_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir)


def _excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = base.actions(spark, sf_dir).where(asof.is_split())
    return splits.select("ticker", F.col("effective_date").alias("event_date"), F.lit(True).alias("training_exclusion"), F.lit("split").alias("event_type"), F.lit("manual").alias("source"), F.concat_ws("|", "ticker", "effective_date").alias("event_id"), F.col("available_at").alias("known_at"))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    adjusted = _latest(spark, sf_dir).select("ticker", "trading_date", "split_adjusted_close")
    return targets.price_targets(adjusted, base.calendar(spark, sf_dir), _excluded(spark, sf_dir))


def j05_p07_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _targets(spark, sf_dir)
    return df.select("ticker", "decision_date", *[c for h in targets.HORIZONS for c in (F.round(f"target_return_{h}d", 6).alias(f"target_return_{h}d"), F.col(f"target_positive_{h}d"), F.col(f"target_end_date_{h}d"), F.col(f"target_{h}d_training_eligible"))])


def f14_target_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _targets(spark, sf_dir).groupBy("ticker").agg(*[F.count_if(f"target_corporate_action_contaminated_{h}d").alias(f"contaminated_{h}d") for h in targets.HORIZONS])


def w19_p08_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = targets.cross_sectional_rank(_targets(spark, sf_dir), LEAST, (10,))
    return ranked.where("target_rank_10d is not null").select("ticker", "decision_date", F.round("target_rank_10d", 6).alias("target_rank_10d"))


def f15_feature_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base.bars(spark, sf_dir).select("ticker", F.col("trading_date").alias("decision_date"), asof.decision_time("trading_date").alias("decision_time"))
    flagged = asof.contamination(rows, _excluded(spark, sf_dir), base.calendar(spark, sf_dir))
    return flagged.where("feature_corporate_action_contaminated").select("ticker", "decision_date", "corporate_action_reason", "corporate_action_event_id")


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = base.bars(spark, sf_dir)
    count = F.count(F.lit(1)).over(Window.partitionBy("ticker").orderBy("trading_date"))
    features = bars.select("ticker", F.col("trading_date").alias("decision_date"), (count > 252).alias("model_eligible"), F.lit(None).cast("boolean").alias("feature_corporate_action_contaminated"))
    return targets.training_dataset(features, _targets(spark, sf_dir), 10)


def j01_p09_training_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(spark, sf_dir).groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"), F.count_if("training_eligible").alias("eligible"))


def p11_f18_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = targets.supervised_split(_joined(spark, sf_dir), "target_end_date_10d", SPLITS, base.calendar(spark, sf_dir), embargo=5)
    return targets.split_manifest(masked, list(SPLITS))


def p12_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [targets.walkforward_schedule(base.calendar(spark, sf_dir), f).withColumn("frequency", F.lit(f)) for f in targets.PERIOD]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def w24_model_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    calendar = base.calendar(spark, sf_dir)
    return targets.model_age(calendar, targets.walkforward_schedule(calendar, "semiannual")).groupBy("bucket").agg(F.count(F.lit(1)).alias("sessions"), F.max("sessions_since_fit").alias("oldest"))


def f18_training_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each annual refit may use, with labels that end before its first prediction (J13 too)."""
    rows = _targets(spark, sf_dir).where("target_10d_training_eligible").select("decision_date", "target_end_date_10d")
    schedule = targets.walkforward_schedule(base.calendar(spark, sf_dir), "annual")
    return targets.training_counts(rows, schedule, "annual", "target_end_date_10d")


def j08_n01_latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _revisions(spark, sf_dir)
    return asof.query_as_of(records, F.to_timestamp(F.lit("2024-01-20 00:00:00")), ["purchase", "click"]).select("provider_news_id", "revision_id", "effective_at")


def _revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = base.read(spark, sf_dir, "events")
    return events.select(F.lit("events").alias("provider"), F.col("user_id").alias("provider_news_id"), F.col("event_id").alias("revision_id"), F.col("ts").cast("timestamp").alias("available_at"), F.col("ts").cast("timestamp").alias("first_seen_at"), F.lit(None).cast("timestamp").alias("published_at"), F.array("event_type").alias("direct_tickers"))


def n02_revision_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions of each article, in order, and which fields changed across them (N12)."""
    events = base.read(spark, sf_dir, "events")
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("revisions"), F.count_distinct("event_type").alias("types"), F.count_distinct("value").alias("values"), F.min_by("event_id", F.struct("ts", "event_id")).alias("first_revision"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_revision"))


QUERIES = {
    "f01_visible_bars": f01_visible_bars,
    "f02_visible_splits": f02_visible_splits,
    "f03_action_types": f03_action_types,
    "p01_extract_actions": p01_extract_actions,
    "p02_j06_latest_basis": p02_latest_basis,
    "p03_as_of_basis": p03_as_of,
    "j07_segments": j07_segments,
    "p04_segment_features": p04_segment_features,
    "a03_history_count": a03_history_count,
    "p10_detect_events": p10_detect_events,
    "j05_p07_targets": j05_p07_targets,
    "f14_target_contamination": f14_target_contamination,
    "w19_p08_rank": w19_p08_rank,
    "f15_feature_contamination": f15_feature_contamination,
    "j01_p09_training_dataset": j01_p09_training_dataset,
    "p11_purge_embargo": p11_f18_purge,
    "p12_schedule": p12_schedule,
    "w24_model_age": w24_model_age,
    "f18_training_window": f18_training_window,
    "j08_n01_latest_revision": j08_n01_latest_revision,
    "n02_n12_revision_audit": n02_revision_audit,
}

_CUTOFF = "timestamp '1998-06-16 00:15:00'"
_FACTORS = "daily as (select ticker, effective_date, product(split_factor) as f from actions where action_type = 'split' {where} group by all), adjusted as (select b.*, coalesce((select product(f) from daily d where d.ticker = b.ticker and d.effective_date > b.trading_date), 1.0) as factor from bars b {bars})"
_LATEST = _FACTORS.format(where="", bars="")
_ASOF = _FACTORS.format(where=f"and effective_date <= date '{DAY}' and available_at <= {_CUTOFF}", bars=f"where trading_date <= date '{DAY}'")
_TARGETS = _LATEST + ", price as (select ticker, trading_date, close / factor as p from adjusted), t as (select a.ticker, a.trading_date as decision_date, " + ", ".join(
    f"c{h}.session as end_{h}, f{h}.p / a.p - 1 as r_{h}, exists(select 1 from actions x where x.action_type = 'split' and x.ticker = a.ticker and a.trading_date < x.effective_date and x.effective_date <= c{h}.session) as bad_{h}" for h in (5, 10, 20)
) + " from price a join calendar c on c.session = a.trading_date " + " ".join(f"left join calendar c{h} on c{h}.seq = c.seq + {h} left join price f{h} on f{h}.ticker = a.ticker and f{h}.trading_date = c{h}.session" for h in (5, 10, 20)) + ")"
_ELIGIBLE = _TARGETS + ", h as (select ticker, trading_date, count(*) over (partition by ticker order by trading_date) > 252 as ok from bars), e as (select t.*, coalesce(h.ok and r_10 is not null and not bad_10, false) as good from t join h on h.ticker = t.ticker and h.trading_date = t.decision_date)"
_PERIODS = {"monthly": "date_trunc('month', session)", "quarterly": "date_trunc('quarter', session)", "semiannual": "make_date(year(session), case when month(session) <= 6 then 1 else 7 end, 1)", "annual": "date_trunc('year', session)"}


def _schedule(frequency: str) -> str:
    return f"select cast(row_number() over (order by p) as integer) as sequence, prediction_start, prediction_end, sessions, '{frequency}' as frequency from (select cast({_PERIODS[frequency]} as date) as p, min(session) as prediction_start, max(session) as prediction_end, count(*) as sessions from calendar group by 1)"


ORACLES = {
    "f01_visible_bars": base.sql(f"select ticker, count(*) as bars, max(trading_date) as last_date from bars where trading_date <= date '{DAY}' group by 1"),
    "f02_visible_splits": base.sql(f"select ticker, effective_date, split_factor from actions where action_type like '%split' and effective_date <= date '{DAY}' and available_at <= {_CUTOFF}"),
    "f03_action_types": base.sql("select ticker, count(case when action_type like '%split' then 1 end) as splits, count(case when action_type like '%dividend' then 1 end) as dividends from actions group by 1"),
    "p01_extract_actions": base.sql("select a.ticker, effective_date, case when action_type = 'split' then 'split' else 'dividend' end as action_type, split_factor, cast(dividend_cash as double) as dividend_cash from actions a join bars b on b.ticker = a.ticker and b.trading_date = a.effective_date"),
    "p02_j06_latest_basis": base.sql("select ticker, trading_date, factor, close / factor as split_adjusted_close, volume * factor as split_adjusted_volume from adjusted", _LATEST),
    "p03_as_of_basis": base.sql("select ticker, trading_date, factor, close / factor as split_adjusted_close from adjusted", _ASOF),
    "j05_p07_targets": base.sql("select ticker, decision_date, " + ", ".join(f"round(r_{h}, 6) as target_return_{h}d, cast(r_{h} > 0 as integer) as target_positive_{h}d, end_{h} as target_end_date_{h}d, r_{h} is not null and not bad_{h} as target_{h}d_training_eligible" for h in (5, 10, 20)) + " from t", _TARGETS),
    "f14_target_contamination": base.sql("select ticker, " + ", ".join(f"count(case when bad_{h} then 1 end) as contaminated_{h}d" for h in (5, 10, 20)) + " from t group by 1", _TARGETS),
    "w19_p08_rank": base.sql(f"select ticker, decision_date, round((rk + (ties - 1) / 2.0 - 1) / (n - 1), 6) as target_rank_10d from (select ticker, decision_date, rank() over (partition by decision_date order by r_10) as rk, count(*) over (partition by decision_date, r_10) as ties, count(*) over (partition by decision_date) as n from t where r_10 is not null and not bad_10) where n >= {LEAST}", _TARGETS),
    "f15_feature_contamination": base.sql("select ticker, decision_date, 'split' as corporate_action_reason, max_by(ticker || '|' || cast(event_date as varchar), event_date) as corporate_action_event_id from (select b.ticker, b.trading_date as decision_date, x.effective_date as event_date from actions x join calendar ce on ce.session = x.effective_date join calendar cb on cb.seq between ce.seq - 1 and ce.seq + 1 join bars b on b.ticker = x.ticker and b.trading_date = cb.session where x.action_type = 'split' and x.available_at <= cast(b.trading_date as timestamp) + interval 24 hour + interval 15 minute) group by 1, 2"),
    "j01_p09_training_dataset": base.sql("select ticker, count(*) as rows, count(case when good then 1 end) as eligible from e group by 1", _ELIGIBLE),
    "p11_purge_embargo": base.sql("select " + ", ".join(
        f"count(case when {inside} then 1 end) as in_{n}, count(case when {inside} and good then 1 end) as eligible_{n}, count(case when {inside} and good{purge} then 1 end) as purged_{n}, count(case when {inside} and good{purge}{embargo} then 1 end) as final_{n}"
        for n, inside, purge, embargo in (
            ("train", "decision_date between date '1995-01-01' and date '1998-12-31'", " and end_10 < date '1999-01-01'", ""),
            ("validation", "decision_date between date '1999-01-01' and date '1999-12-31'", " and end_10 < date '2000-01-01'", " and decision_date > (select max(session) from (select session from calendar where session >= date '1999-01-01' order by session limit 5))"),
            ("test", "decision_date >= date '2000-01-01'", "", " and decision_date > (select max(session) from (select session from calendar where session >= date '2000-01-01' order by session limit 5))"),
        )
    ) + " from e", _ELIGIBLE),
    "p12_schedule": base.sql(" union all ".join(_schedule(f) for f in _PERIODS)),
    "w24_model_age": base.sql("select bucket, count(*) as sessions, max(age) as oldest from (select age, case when age <= 20 then '0-20' when age <= 40 then '21-40' when age <= 60 then '41-60' when age <= 120 then '61-120' else '121+' end as bucket from (select row_number() over (partition by year(session), month(session) <= 6 order by session) - 1 as age from calendar)) group by 1"),
    "f18_training_window": base.sql("select sequence, count(*) as rows, max(end_10) as last_label from t join (" + _schedule("annual") + ") s on end_10 < prediction_start and decision_date < prediction_start where r_10 is not null and not bad_10 group by 1", _TARGETS),
    "j08_n01_latest_revision": "select provider_news_id, revision_id, effective_at from (select user_id as provider_news_id, event_id as revision_id, ts as effective_at, event_type, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events where ts <= timestamp '2024-01-20 00:00:00') where n = 1 and event_type in ('purchase', 'click')",
    "n02_n12_revision_audit": "select user_id, count(*) as revisions, count(distinct event_type) as types, count(distinct value) as values, first(event_id order by ts, event_id) as first_revision, last(event_id order by ts, event_id) as last_revision from events group by 1",
}
