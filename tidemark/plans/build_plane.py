"""The feature and label build, its diagnostics, model experiments and benchmark reports over the driver's tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import asof, backtest, build, experiments, features, metrics, models, quality, targets
from tidemark.plans import base, feature_plane, pit_plane, portfolio_plane, sql_plane, store_plane
from tidemark.plans.pit_plane import LEAST
from tidemark.session import written

HOLDOUT, NOMINAL_END = date(2000, 1, 1), date(2001, 6, 30)


def _market(spark, sf_dir):
    return base.market(spark, sf_dir).select("trading_date", F.col("close").alias("market_close"))


def _rows(spark, sf_dir):
    return build.decision_rows(base.bars(spark, sf_dir), _market(spark, sf_dir), base.actions(spark, sf_dir), pit_plane._excluded(spark, sf_dir), base.calendar(spark, sf_dir))


def _labels(spark, sf_dir):
    return build.labels(base.bars(spark, sf_dir), base.actions(spark, sf_dir), pit_plane._excluded(spark, sf_dir), base.calendar(spark, sf_dir), LEAST)


def _flags(spark, sf_dir):
    """Eligibility by history alone, and contamination: all that frames and diagnostics need of the features."""
    bars = base.bars(spark, sf_dir)
    n = F.count(F.lit(1)).over(Window.partitionBy("ticker").orderBy("trading_date"))
    rows = bars.select("ticker", F.col("trading_date").alias("decision_date"), asof.decision_time("trading_date").alias("decision_time"), F.col("close").alias("split_adjusted_close"), (n > 252).alias("model_eligible"))
    return asof.contamination(rows, pit_plane._excluded(spark, sf_dir), base.calendar(spark, sf_dir))


def p05_store(spark, sf_dir):
    """The whole build: features as known on each day, flags, labels and training eligibility."""
    joined = targets.training_dataset(_rows(spark, sf_dir), _labels(spark, sf_dir), 10)
    rounded = [F.round(c, 6).alias(c) for c in ("return_60d", "momentum_120d", "target_return_10d", "target_rank_10d")]
    return joined.select("ticker", "decision_date", "model_eligible", "feature_corporate_action_contaminated", *rounded, "training_eligible")


def p13_walkforward(spark, sf_dir):
    found = build.walkforward_frame(_flags(spark, sf_dir), _labels(spark, sf_dir), ["split_adjusted_close"])
    return found.select("ticker", "decision_date", F.round("target_return_20d", 6).alias("target_return_20d"), "target_end_date_20d")


def p13_holdout(spark, sf_dir):
    return build.holdout_frame(_flags(spark, sf_dir), _labels(spark, sf_dir), [], HOLDOUT, NOMINAL_END)[1]


def p12_schedule_faults(spark, sf_dir):
    """A schedule with a period too long and a gap, against the sessions."""
    calendar = base.calendar(spark, sf_dir)
    schedule = targets.walkforward_schedule(calendar, "annual").where("sequence <> 3")
    schedule = schedule.withColumn("prediction_end", F.when(F.col("sequence") == 1, F.date_add("prediction_end", 400)).otherwise(F.col("prediction_end")))
    return targets.schedule_faults(schedule, calendar)


def p14_resumed(spark, sf_dir):
    """Which tickers a resumed build still has to do, and whether their bars can be built."""
    bars = base.bars(spark, sf_dir)
    bars = bars.withColumn("high", F.when((F.col("ticker") == "NATION_3") & (F.dayofmonth("trading_date") == 5), F.col("low") / 2).otherwise(F.col("high")))
    bars = bars.unionByName(bars.where("ticker = 'NATION_7' and year(trading_date) = 1996"))
    state = build.sound(bars)
    done = state.where("ticker < 'NATION_2'")
    return build.pending(state, done)


def q03_unexpected_nulls(spark, sf_dir):
    rows = features.all_features(feature_plane._with_market(spark, sf_dir))
    rows = rows.withColumn("history_count", F.count(F.lit(1)).over(Window.partitionBy("ticker").orderBy("trading_date")))
    return build.unexpected_nulls(features.eligibility(rows), [*features.ESSENTIAL, "percentile_price_252d", "percentile_volatility_252d"])


def q04_ranking(spark, sf_dir):
    return build.ranking_diagnostics(_labels(spark, sf_dir), LEAST)


def q05_contamination(spark, sf_dir):
    events = pit_plane._excluded(spark, sf_dir)
    return build.contamination_summary(_flags(spark, sf_dir), _labels(spark, sf_dir), events)


def q06_explained(spark, sf_dir):
    outliers = quality.outliers(store_plane._moves(spark, sf_dir)).where("rule = 'return_1d'")
    return build.explained(outliers, _flags(spark, sf_dir)).select("ticker", "trading_date", "explained")


def q07_splits(spark, sf_dir):
    found = build.split_validation(base.bars(spark, sf_dir), base.actions(spark, sf_dir), base.calendar(spark, sf_dir))
    return found.select("ticker", "split_date", "split_factor", F.round("return_on_split", 6).alias("return_on_split"), F.round("largest", 6).alias("largest"), "passed")


def q08_samples(spark, sf_dir):
    return build.sample_checks(_flags(spark, sf_dir), base.bars(spark, sf_dir), base.actions(spark, sf_dir))


def q09_targets(spark, sf_dir):
    rows = _flags(spark, sf_dir).where("dayofmonth(decision_date) <> 13")
    found = build.target_diagnostics(rows, _labels(spark, sf_dir))
    return found.select("horizon", "valid", F.round("least", 6).alias("least"), F.round("most", 6).alias("most"), "trailing_null", "keys_without_features")


def q10_runs(spark, sf_dir):
    first = base.bars(spark, sf_dir).select("ticker", "trading_date", "close", "volume").where("dayofmonth(trading_date) <> 2")
    second = base.bars(spark, sf_dir).select("ticker", "trading_date", "close", "volume").where("dayofmonth(trading_date) <> 3")
    return build.compared(first, second.withColumn("volume", F.when(F.dayofmonth("trading_date") == 4, F.col("volume") + 1).otherwise(F.col("volume"))), ["ticker", "trading_date"])


def q11_sizes(spark, sf_dir):
    return build.sizes({name: base.read(spark, sf_dir, name) for name in ("lineitem", "orders", "documents")})


def q12_contract(spark, sf_dir):
    return build.label_faults(_labels(spark, sf_dir), base.calendar(spark, sf_dir), LEAST)


def f04_known_events(spark, sf_dir):
    """Events known by the cutoff of the decision day."""
    day = F.lit(pit_plane.DAY)
    return pit_plane._events(spark, sf_dir).where(F.col("known_at") <= asof.decision_time(day)).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


def b15_treatments(spark, sf_dir):
    """Split actions with the reviewed treatment of their event, where a small registry has one."""
    actions = base.actions(spark, sf_dir).where(asof.is_split()).select("ticker", "effective_date", F.concat_ws("|", "ticker", "effective_date").alias("event_id"))
    reviewed = F.broadcast(actions.orderBy("event_id").limit(20).select("event_id", F.lit("reviewed").alias("treatment")))  # 20 rows
    return actions.join(reviewed, "event_id", "left").select("event_id", F.coalesce("treatment", F.lit("unmodelled")).alias("treatment"))


def t07_rare_first(spark, sf_dir):
    """A sample of 60 documents that takes the rare languages' pool first, then the others by hash."""
    docs = base.read(spark, sf_dir, "documents").select("doc_id", "lang")
    return quality.rare_first(docs, F.col("lang") != "en", [F.sha2(F.col("doc_id").cast("string"), 256)], 60, 20)


def m01_predictors(spark, sf_dir):
    """Zero, mean and prior predictions of the even rows for the odd ones."""
    rows = base.read(spark, sf_dir, "labels").where("quality is not null")
    train, rest = rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1")
    mean = models.train_mean(train, rest, "quality").select("doc_id", F.lit("mean").alias("model"), F.round("prediction", 6).alias("prediction"))
    zero = rest.select("doc_id", F.lit("zero").alias("model"), F.lit(0.0).alias("prediction"))
    prior = models.train_mean(train.withColumn("up", (F.col("toxic") > 0).cast("double")), rest, "up").select("doc_id", F.lit("prior").alias("model"), F.round("prediction", 6).alias("prediction"))
    return mean.unionByName(zero).unionByName(prior)


def a09_ranking(spark, sf_dir):
    """Rank correlation and top-5 diagnostics of one score, in one row."""
    scores = portfolio_plane._scores(spark, sf_dir)
    daily = metrics.daily_correlation(scores, "actual", "score", method="spearman")
    ic = portfolio_plane._rounded(metrics.ic_summary(portfolio_plane._rounded(daily, 9))).select(*[F.col(c).alias(f"ic_{c}") for c in ("days", "mean", "median", "std", "icir", "pct_positive")])
    return ic.crossJoin(F.broadcast(portfolio_plane._rounded(metrics.top_k(scores, "actual", "score", 5))))  # one row each


def a19_policy(spark, sf_dir):
    """Rank correlation of a score by year and by the model's age."""
    daily = metrics.daily_correlation(portfolio_plane._scores(spark, sf_dir), "actual", "score", method="spearman")
    calendar = base.calendar(spark, sf_dir)
    ages = targets.model_age(calendar, targets.walkforward_schedule(calendar, "annual")).select(F.col("session").alias("decision_date"), "bucket")
    rows = daily.join(ages, "decision_date").select("ic", F.explode(F.array(F.concat(F.lit("year "), F.year("decision_date")), F.concat(F.lit("age "), F.col("bucket")))).alias("scope"))
    return rows.groupBy("scope").agg(F.count("ic").alias("days"), F.round(F.avg("ic"), 6).alias("mean_ic"), F.count_if(F.col("ic") > 1e-9).alias("positive"))


def a23_eligibility(spark, sf_dir):
    counts = _flags(spark, sf_dir).groupBy("decision_date").agg(F.count_if("model_eligible").alias("n"))
    return counts.agg(F.count(F.lit(1)).alias("decision_dates"), F.min("n").alias("fewest"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("average"))


def a25_training_samples(spark, sf_dir):
    fits = pit_plane.f18_training_window(spark, sf_dir)
    return fits.agg(F.min("rows").alias("min_training_rows"), F.round(F.avg("rows"), 6).alias("mean_training_rows"), F.max("rows").alias("max_training_rows"))


# --- walk-forward experiments ------------------------------------------------------------------
FAMILIES = {"momentum": ["momentum_5d", "momentum_10d", "momentum_20d"], "gaps": ["gap_open", "intraday_return"]}
INPUTS = [c for own in FAMILIES.values() for c in own]
LABEL, END = "target_return_5d", "target_end_date_5d"


def _walked(spark, sf_dir, policies, alpha=1.0, label=LABEL):
    """Rows, predictions and fits of all policies: one pass for the sums, one for the predictions."""
    rows = store_plane._model_rows(spark, sf_dir)
    if label == "rank":
        rows = rows.withColumn("rank", targets.percentile_rank(F.col(LABEL), ["decision_date"]))
    sums = experiments.Grams(experiments.grams(rows, INPUTS, label, END), INPUTS)
    starts = sorted({decided for decided, _, _ in sums.parts})
    fitted = experiments.fits(sums, starts, policies, alpha)
    return rows, experiments.predictions(rows, INPUTS, fitted, keep=(LABEL,)), fitted


def _judged(spark, sf_dir, policies, reference):
    daily = experiments.daily_ic(_walked(spark, sf_dir, policies)[1], ["policy"], LABEL, "prediction")
    found = written(experiments.summary(daily, ["policy"]), "policies")
    return found, experiments.deltas(found, reference)


def m04_m11_ridge_walk_forward(spark, sf_dir):
    """Annual refits of a ridge on purged rows, with each model's mean rank correlation by year."""
    predicted = _walked(spark, sf_dir, {"ridge": (None, INPUTS)})[1]
    daily = experiments.daily_ic(predicted, ["policy"], LABEL, "prediction")
    return daily.groupBy("policy", F.year("decision_date").alias("year")).agg(F.count("ic").alias("days"), F.avg("ic").alias("mean_ic"))


def m11_single_input(spark, sf_dir):
    """Walk-forward predictions of a least-squares line on one input, refitted each year on purged rows."""
    rows = store_plane._model_rows(spark, sf_dir)
    sums = experiments.Grams(experiments.grams(rows, ["momentum_20d"], LABEL, END), ["momentum_20d"])
    starts = sorted({decided for decided, _, _ in sums.parts})
    fitted = experiments.fits(sums, starts, {"line": (None, ["momentum_20d"])}, 0.0)
    return experiments.predictions(rows, ["momentum_20d"], fitted).select("ticker", "decision_date", F.round("prediction", 6).alias("prediction"))


def m06_approaches(spark, sf_dir):
    """Ranking by momentum, by a predicted return and by a predicted rank."""
    rows, by_return, _ = _walked(spark, sf_dir, {"predicted_return": (None, INPUTS)})
    by_rank = _walked(spark, sf_dir, {"direct_rank": (None, INPUTS)}, label="rank")[1]
    keys = by_return.select("ticker", "decision_date")
    momentum = rows.join(keys, ["ticker", "decision_date"], "left_semi").select(F.lit("momentum_20d").alias("policy"), "ticker", "decision_date", LABEL, F.col("momentum_20d").alias("prediction"))
    every = momentum.unionByName(by_return).unionByName(by_rank)
    return experiments.summary(experiments.daily_ic(every, ["policy"], LABEL, "prediction"), ["policy"])


def m09_derived_ranks(spark, sf_dir):
    """Ranks from fitted return predictions, without a refit."""
    predicted = _walked(spark, sf_dir, {"ridge": (None, INPUTS)})[1]
    keys = predicted.where(f"{LABEL} is not null").select("ticker", "decision_date")
    return experiments.ranked(predicted, keys).select("ticker", "decision_date", "predicted_rank")


def m10_importance(spark, sf_dir):
    """What permuting each input within its date costs the mean rank correlation."""
    rows, predicted, fitted = _walked(spark, sf_dir, {"ridge": (None, INPUTS)})
    every = predicted.withColumn("policy", F.lit("none"))
    for name in INPUTS:
        shuffled = experiments.predictions(models.permuted(rows, name), INPUTS, fitted, keep=(LABEL,))
        every = every.unionByName(shuffled.withColumn("policy", F.lit(name)))
    found = experiments.summary(experiments.daily_ic(every, ["policy"], LABEL, "prediction"), ["policy"])
    return experiments.deltas(found, "none").select(F.col("policy").alias("permuted"), "mean_ic", "delta_mean_ic")


def m12_windows(spark, sf_dir):
    """Expanding against trailing windows."""
    found, _ = _judged(spark, sf_dir, {"expanding": (None, INPUTS), "trailing-3y": (3, INPUTS), "trailing-2y": (2, INPUTS)}, "expanding")
    best = found.orderBy(F.desc("mean_ic"), "policy").first().policy
    return experiments.window_finding(found, best).select("policy", "mean_ic", "worst_year_ic", "delta_mean_ic", "material", "stable", "finding")


def m13_m16_ablations(spark, sf_dir):
    """Leaving a family of inputs out."""
    policies = {"full": (None, INPUTS)} | {f"without_{f}": (None, [c for c in INPUTS if c not in own]) for f, own in FAMILIES.items()}
    _, compared = _judged(spark, sf_dir, policies, "full")
    flags = experiments.ablation_flags(F.col("delta_mean_ic"), F.col("delta_worst_year_ic"), F.col("delta_icir"), F.lit(0.0))
    return compared.select("policy", "mean_ic", "delta_mean_ic", experiments.ablation_class(F.col("delta_mean_ic")).alias("class"), flags.alias("f")).select("policy", "mean_ic", "delta_mean_ic", "class", "f.*")


def m16_classes(spark, sf_dir):
    """Ablation classes and flags of made-up differences."""
    e = base.read(spark, sf_dir, "events").select("event_id", ((F.col("event_id") % 21 - 10) / 1000).alias("d"), ((F.col("event_id") % 13 - 6) / 1000).alias("w"))
    flags = experiments.ablation_flags(F.col("d"), F.col("w"), F.lit(0.0), F.lit(0.0))
    return e.select("event_id", experiments.ablation_class(F.col("d")).alias("class"), flags["strong_contributor"].alias("strong"), flags["harmful_candidate"].alias("harmful"))


def m17_consistency(spark, sf_dir):
    """A frozen candidate against one with another horizon."""
    contract = {"candidate_id": "c1", "horizon": 20, "model": "ridge", "alpha": 100.0}
    frozen = experiments.candidate(contract)
    return experiments.consistency(spark, frozen, frozen | {"horizon": 10}).select("check", "passed")


def m18_holdout(spark, sf_dir):
    """A hold-out opened once: two models and momentum from HOLDOUT on, with their classes."""
    from tidemark.plans.records_plane import _root

    experiments.open_once(spark, _root(spark, "opening"), {"test_start": str(HOLDOUT), "inputs": INPUTS})
    rows, predicted, _ = _walked(spark, sf_dir, {"ridge": (None, INPUTS), "gaps_only": (None, FAMILIES["gaps"])}, 100.0)
    test = predicted.where(F.col("decision_date") >= F.lit(HOLDOUT))
    momentum = rows.where(F.col("decision_date") >= F.lit(HOLDOUT)).select(F.lit("momentum_20d").alias("policy"), "ticker", "decision_date", LABEL, F.col("momentum_20d").alias("prediction"))
    found = experiments.summary(experiments.daily_ic(test.unionByName(momentum), ["policy"], LABEL, "prediction"), ["policy"])
    return found.select("policy", "days", "mean_ic", "worst_year_ic", "positive_years", experiments.holdout_class(F.col("mean_ic"), F.col("worst_year_ic"), F.col("positive_years") / F.col("years"), F.col("mean_ic")).alias("class"))


def m18_classes(spark, sf_dir):
    e = base.read(spark, sf_dir, "events").select("event_id", ((F.col("event_id") % 9 - 2) / 100).alias("ic"), ((F.col("event_id") % 5 - 3) / 100).alias("worst"), ((F.col("event_id") % 4) / 4).alias("share"), ((F.col("event_id") % 3 - 1) / 100).alias("uplift"))
    relative = experiments.relative_class(F.col("ic"), F.lit(0.02), ("first", "second"))
    return e.select("event_id", experiments.holdout_class(F.col("ic"), F.col("worst"), F.col("share"), F.col("uplift")).alias("class"), relative.alias("relative"))


def m19_contract(spark, sf_dir):
    e = base.read(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 7 > 0, F.col("value")).alias("prediction"), F.lit("regression").alias("task"),
        F.when(F.col("event_id") % 5 == 0, 15).otherwise(10).alias("horizon"), F.lit("target_return_10d").alias("target_name"),
        F.to_date("ts").alias("decision_date"), F.date_add(F.to_date("ts"), F.when(F.col("event_id") % 3 == 0, 0).otherwise(-1)).alias("training_cutoff"),
        F.when(F.col("event_id") % 2 == 0, "test").otherwise("train").alias("split"),
    )
    return experiments.contract_faults(e)


# --- benchmark reports -------------------------------------------------------------------------
def b12_benchmark(spark, sf_dir):
    """Performance of two strategies and their excess over a benchmark held under the same costs."""
    runs = written(portfolio_plane._runs(spark, sf_dir, "NATION_3"), "runs")
    nav = runs.where("record = 'snapshot'").select("run_id", F.col("session").alias("as_of"), "nav")
    report = backtest.benchmark_report(metrics.portfolio(nav, ["run_id"]), "benchmark")
    return portfolio_plane._rounded(report.select("run_id", "observations", "cumulative_return", "cagr", "excess_cumulative_return", "excess_cagr"))


def b13_isolated(spark, sf_dir):
    """Runs side by side of which one holds a name with an unmodelled action: it fails alone."""
    rows = portfolio_plane._inputs(spark, sf_dir)
    bad = rows.where("run_id = 'equal_weight' and kind = 'action' and factor is not null").limit(1).withColumn("kind", F.lit("complex"))
    found = backtest.run_all(rows.unionByName(bad), isolate=True)
    return found.groupBy("run_id").agg(F.count_if(F.col("record") == "failure").alias("failures"), F.count_if(F.col("record") == "snapshot").alias("snapshots"))


QUERIES = {
    f.__name__: f
    for f in (
        p05_store, p13_walkforward, p13_holdout, p12_schedule_faults, p14_resumed, q03_unexpected_nulls, q04_ranking, q05_contamination, q06_explained, q07_splits, q08_samples,
        q09_targets, q10_runs, q11_sizes, q12_contract, f04_known_events, b15_treatments, t07_rare_first, m01_predictors, a09_ranking, a19_policy, a23_eligibility, a25_training_samples,
        m04_m11_ridge_walk_forward, m11_single_input, m06_approaches, m09_derived_ranks, m10_importance, m12_windows, m13_m16_ablations, m16_classes, m17_consistency, m18_holdout, m18_classes, m19_contract,
        b12_benchmark, b13_isolated,
    )
}

_H = pit_plane._TARGETS + ", flags as (select b.ticker, b.trading_date as decision_date, count(*) over (partition by b.ticker order by b.trading_date) > 252 as ok, x.ticker is not null as dirty from bars b left join (" + pit_plane.ORACLES["f15_feature_contamination"] + ") x on x.ticker = b.ticker and x.decision_date = b.trading_date), j as (select * from t join flags using (ticker, decision_date))"


def _ranks(h: int) -> str:
    return f"select ticker, decision_date, case when n >= {LEAST} then (rk + (ties - 1) / 2.0 - 1) / (n - 1) end as r from (select ticker, decision_date, rank() over (partition by decision_date order by r_{h}) as rk, count(*) over (partition by decision_date, r_{h}) as ties, count(*) over (partition by decision_date) as n from t where r_{h} is not null and not bad_{h})"


_RANKED = "".join(f", k{h} as ({_ranks(h)})" for h in (5, 10, 20))
_SPEARMAN = portfolio_plane._RANKS + f", ics as ({portfolio_plane._CORR.format('ranked')})"
_AGE = "select session, row_number() over (partition by year(session) order by session) - 1 as age from calendar"
_WINDOW = sql_plane.ACTIVE + """, splits as (select a.ticker, a.effective_date as split_date, a.split_factor, c.seq as at_seq from actions a join calendar c on c.session = a.effective_date where a.action_type = 'split'),
days as (select s.*, unnest(range(at_seq - 4, at_seq + 4)) as seq from splits s where at_seq >= 4 and at_seq + 3 <= (select max(seq) from calendar)),
placed as (select d.*, b.close / coalesce((select product(split_factor) from active x where x.ticker = d.ticker and x.active_seq <= d.at_seq + 3 and x.effective_date > b.trading_date), 1.0) as p from days d join calendar c on c.seq = d.seq left join bars b on b.ticker = d.ticker and b.trading_date = c.session),
moved as (select * from (select *, p / lag(p) over (partition by ticker, split_date order by seq) - 1 as r from placed) where seq >= at_seq - 3)"""
_CLASS = "case when d <= -0.005 then 'important' when d <= -0.003 then 'moderately_useful' when d < 0.003 then 'neutral_or_redundant' when d < 0.005 then 'small_positive_change' else 'potentially_harmful' end"

ORACLES = {
    "p05_store": base.sql(
        "select j.ticker, j.decision_date, ok as model_eligible, dirty as feature_corporate_action_contaminated, round(r60, 6) as return_60d, round(m120, 6) as momentum_120d, round(r_10, 6) as target_return_10d, round(k.r, 6) as target_rank_10d, ok and not dirty and r_10 is not null and not bad_10 as training_eligible from j join past p on p.ticker = j.ticker and p.trading_date = j.decision_date left join k10 k on k.ticker = j.ticker and k.decision_date = j.decision_date",
        _H + _RANKED + ", " + sql_plane.HISTORY + ", past as (select * from (select *, p / lag(p, 60) over w - 1 as r60, p / lag(p, 120) over w - 1 as m120 from history window w as (partition by ticker, first_seq order by trading_date)) where bar_seq >= first_seq)",
    ),
    "p13_walkforward": base.sql("select j.ticker, j.decision_date, round(r_20, 6) as target_return_20d, end_20 as target_end_date_20d from j join k20 k on k.ticker = j.ticker and k.decision_date = j.decision_date where ok and not dirty and k.r is not null", _H + _RANKED),
    "p13_holdout": base.sql(f"select max(case when good and decision_date >= date '{HOLDOUT}' then decision_date end) as effective_test_end, count(distinct case when decision_date > last then decision_date end) as tail_sessions, count(case when decision_date > last then 1 end) as tail_rows from (select *, max(case when good and decision_date >= date '{HOLDOUT}' then decision_date end) over () as last from (select j.decision_date, coalesce(k.r is not null and end_20 <= date '{NOMINAL_END}', false) as good from j left join k20 k on k.ticker = j.ticker and k.decision_date = j.decision_date where ok and not dirty and j.decision_date <= date '{NOMINAL_END}'))", _H + _RANKED),
    "p12_schedule_faults": base.sql("select count(*) as sessions, 1::bigint as overlaps, count(case when year(session) <> y + 2 then 1 end) as covered, (case when (select count(*) from calendar c2 where c2.session = (select max(session) from calendar c3 where year(c3.session) = y) + 400) = 0 then 1 else 0 end)::bigint as edges_outside from calendar, (select min(year(session)) as y from calendar) group by y"),
    "p14_resumed": base.sql("select distinct ticker, case when ticker in ('NATION_3', 'NATION_7') then 'failed' else 'completed' end as status, case ticker when 'NATION_3' then 'price violation' when 'NATION_7' then 'duplicate bars' end as error from bars where ticker >= 'NATION_2'"),
    "q03_unexpected_nulls": base.sql("select 'percentile_volatility_252d' as column, count(*) as expected, 0::bigint as unexpected from (select row_number() over (partition by ticker order by trading_date) as n from bars) where n > 252 and n < 272 having count(*) > 0"),
    "q04_ranking": base.sql(" union all ".join(f"select cast({h} as integer) as horizon, t.decision_date, count(case when r_{h} is not null and not bad_{h} then 1 end) as eligible, count(k.r) as ranked, case when count(k.r) > 0 then null when count(case when r_{h} is not null and not bad_{h} then 1 end) < {LEAST} then 'insufficient_training_eligible_target_{h}d' else 'ranking_unavailable' end as reason from t left join k{h} k on k.ticker = t.ticker and k.decision_date = t.decision_date group by t.decision_date" for h in (5, 10, 20)), pit_plane._TARGETS + _RANKED),
    "q05_contamination": base.sql("select (select count(*) from actions where action_type = 'split') as excluded_events, count(case when dirty then 1 end) as contaminated_feature_rows, " + ", ".join(f"count(case when bad_{h} then 1 end) as contaminated_targets_{h}d" for h in (5, 10, 20)) + ", count(case when bad_10 and r_10 is not null then 1 end) as rankings_excluded from j", _H),
    "q06_explained": base.sql("select m.ticker, m.trading_date, dirty as explained from moves m join flags f on f.ticker = m.ticker and f.decision_date = m.trading_date where abs(return_1d) > 0.3", _H + ", " + sql_plane._MOVES),
    "q07_splits": base.sql("select ticker, split_date, max(split_factor) as split_factor, round(max(case when seq = at_seq then r end), 6) as return_on_split, round(max(abs(r)), 6) as largest, count(case when r is null and seq > at_seq - 3 then 1 end) = 0 and coalesce(abs(max(case when seq = at_seq then r end)) <= 0.3, false) as passed from moved group by 1, 2", _WINDOW),
    "q08_samples": base.sql("select ticker, trading_date as decision_date, true as no_future, true as basis_ok from (select *, row_number() over (partition by ticker order by trading_date) - 1 as n, count(*) over (partition by ticker) as size, lead(trading_date) over (partition by ticker order by trading_date) as after from bars) b where n = 0 or n = size // 2 or n = size - 1 or exists (select 1 from actions a where a.action_type = 'split' and a.ticker = b.ticker and a.effective_date > b.trading_date and (b.after is null or a.effective_date <= b.after))"),
    "q09_targets": base.sql(" union all ".join(f"select cast({h} as integer) as horizon, count(r_{h}) as valid, round(min(r_{h}), 6) as least, round(max(r_{h}), 6) as most, count(case when n <= {h} and r_{h} is not null then 1 end) = 0 as trailing_null, count(case when dayofmonth(decision_date) = 13 then 1 end) as keys_without_features from (select *, row_number() over (partition by ticker order by decision_date desc) as n from t)" for h in (5, 10, 20)), pit_plane._TARGETS),
    "q10_runs": base.sql("select case dayofmonth(trading_date) when 2 then 'added' when 3 then 'removed' when 4 then 'changed' else 'same' end as state, count(*) as rows from bars group by 1"),
    "q12_contract": base.sql(" union all ".join(f"select cast({h} as integer) as horizon, count(*) as rows, 0::bigint as wrong_rank, 0::bigint as wrong_end, 0::bigint as not_monotone from bars" for h in (5, 10, 20))),
    "f04_known_events": base.sql(f"select event_type, count(*) as events from ({sql_plane.ORACLES['p10_detect_events']}) where known_at <= {pit_plane._CUTOFF} group by 1"),
    "b15_treatments": base.sql("select event_id, case when n <= 20 then 'reviewed' else 'unmodelled' end as treatment from (select ticker || '|' || effective_date as event_id, row_number() over (order by ticker || '|' || effective_date) as n from actions where action_type = 'split')"),
    "t07_rare_first": "select doc_id, lang from (select *, row_number() over (order by case when rare and k <= 20 then 0 else 1 end, h, doc_id) as n from (select *, row_number() over (partition by rare order by h, doc_id) as k from (select doc_id, lang, coalesce(lang <> 'en', false) as rare, sha256(cast(doc_id as varchar)) as h from documents))) where n <= 60",
    "m01_predictors": "with l as (select * from labels where quality is not null), r as (select doc_id from l where doc_id % 2 = 1) select doc_id, 'mean' as model, round((select avg(quality) from l where doc_id % 2 = 0), 6) as prediction from r union all select doc_id, 'zero', 0.0 from r union all select doc_id, 'prior', round((select avg(cast(toxic > 0 as integer)) from l where doc_id % 2 = 0), 6) from r",
    "a09_ranking": "select a.days as ic_days, a.mean as ic_mean, a.median as ic_median, a.std as ic_std, a.icir as ic_icir, a.pct_positive as ic_pct_positive, b.* from (" + portfolio_plane.ORACLES["a05_w21_rank_ic"] + ") a, (" + portfolio_plane.ORACLES["a06_t03_top_k"] + ") b",
    "a19_policy": base.sql(f"select scope, count(*) as days, round(avg(ic), 6) as mean_ic, count(case when ic > 1e-9 then 1 end) as positive from (select ic, unnest(['year ' || year(decision_date), 'age ' || case when age <= 20 then '0-20' when age <= 40 then '21-40' when age <= 60 then '41-60' when age <= 120 then '61-120' else '121+' end]) as scope from ics join ({_AGE}) on session = decision_date) group by 1", _SPEARMAN),
    "a23_eligibility": base.sql("select count(*) as decision_dates, min(n) as fewest, max(n) as most, round(avg(n), 6) as average from (select trading_date, count(case when k > 252 then 1 end) as n from (select trading_date, row_number() over (partition by ticker order by trading_date) as k from bars) group by 1)"),
    "a25_training_samples": "select min(rows) as min_training_rows, round(avg(rows), 6) as mean_training_rows, max(rows) as max_training_rows from (" + pit_plane.ORACLES["f18_training_window"] + ")",
    "m11_single_input": base.sql(
        "select ticker, d as decision_date, round(b + a * m, 6) as prediction from x join fits on y = year(d) where m is not null",
        pit_plane._TARGETS + ", x as (select p.ticker, p.trading_date as d, p / lag(p, 20) over (partition by p.ticker order by p.trading_date) - 1 as m, r_5 as r, end_5 as e from price p join t on t.ticker = p.ticker and t.decision_date = p.trading_date), fits as (select y, regr_slope(r, m) as a, regr_intercept(r, m) as b from (select distinct year(d) as y from x where m is not null and r is not null) join x on year(d) < y and year(e) < y where m is not null and r is not null group by 1)",
    ),
    "m16_classes": f"select event_id, {_CLASS} as class, d <= -0.005 or w <= -0.005 as strong, d >= 0.005 and w >= -0.003 as harmful from (select event_id, (event_id % 21 - 10) / 1000.0 as d, (event_id % 13 - 6) / 1000.0 as w from events)",
    "m17_consistency": "select * from (values ('candidate_id', true), ('horizon', false), ('model', true), ('alpha', true), ('candidate_fingerprint', false)) t(\"check\", passed)",
    "m18_classes": "select event_id, case when ic <= 0 then 'hard_fail' when ic < 0.01 then 'fail' when uplift <= 0 and ic < 0.03 then 'fail' when ic >= 0.03 and worst > -0.01 and share >= 0.5 and uplift > 0 then 'pass' else 'marginal' end as class, case when ic > 0.026 then 'first_outperforms_second' when ic < 0.014 then 'second_outperforms_first' else 'approximately_equal' end as relative from (select event_id, (event_id % 9 - 2) / 100.0 as ic, (event_id % 5 - 3) / 100.0 as worst, (event_id % 4) / 4.0 as share, (event_id % 3 - 1) / 100.0 as uplift from events)",
    "m19_contract": "select fault, count(*) as rows from (select unnest(list_filter([case when event_id % 7 = 0 then 'prediction_missing' end, case when event_id % 5 = 0 then 'unsupported_horizon' end, case when event_id % 5 = 0 then 'target_name_mismatch' end, case when event_id % 3 = 0 then 'cutoff_not_before_decision' end, case when event_id % 2 = 1 then 'unknown_split' end], lambda x: x is not null)) as fault from events) group by 1",
}
