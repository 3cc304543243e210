"""The feature and label build, its diagnostics, and the frames that models are trained on."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import asof, features, targets
from tidemark.operators.quality import duplicate_keys, price_violations

HORIZONS = targets.HORIZONS


def decision_rows(bars: DataFrame, market: DataFrame, actions: DataFrame, events: DataFrame, calendar: DataFrame) -> DataFrame:
    """All features of every (ticker, decision_date) on the basis known that day, with eligibility and contamination.

    Segments of constant knowledge see their whole visible history in the recurrences, and the bars
    that a window can reach in all else; they are cut to their own sessions at the end. market:
    trading_date, market_close. events as contamination() takes them.
    """
    history = asof.segment_histories(bars, actions, calendar)
    prices = {c: F.col(f"split_adjusted_{c}") for c in ("open", "high", "low", "close", "volume")}
    own = history.select("ticker", "first_seq", "last_seq", "bar_seq", "trading_date", "available_at", *[x.alias(c) for c, x in prices.items()])
    segment = ["ticker", "first_seq"]
    order = Window.partitionBy(*segment).orderBy("bar_seq")
    smooth = features.add_smoothed(own, segment).withColumn("_n", F.row_number().over(order))
    start = F.min(F.when(F.col("bar_seq") >= F.col("first_seq"), F.col("_n"))).over(Window.partitionBy(*segment))
    reach = smooth.withColumn("_start", start).where(F.col("_n") >= F.col("_start") - features.LOOKBACK).drop("_n", "_start")
    rows = features.add_percentiles(features.windowed(reach.join(market, "trading_date", "left"), segment), segment)
    rows = rows.where("bar_seq between first_seq and last_seq")
    rows = rows.withColumn("history_count", F.count(F.lit(1)).over(Window.partitionBy("ticker").orderBy("bar_seq")))
    rows = features.eligibility(rows).withColumnRenamed("trading_date", "decision_date").withColumn("decision_time", asof.decision_time("decision_date"))
    return asof.contamination(rows, events, calendar)


def labels(bars: DataFrame, actions: DataFrame, events: DataFrame, calendar: DataFrame, least: int = 20) -> DataFrame:
    """Forward returns, their flags and cross-sectional ranks, on the latest basis."""
    adjusted = asof.split_adjusted(bars, actions).select("ticker", "trading_date", "split_adjusted_close")
    return targets.cross_sectional_rank(targets.price_targets(adjusted, calendar, events), least)


def sound(bars: DataFrame) -> DataFrame:
    """(ticker, status, error): which tickers can be built; one with broken bars fails alone."""
    doubled = duplicate_keys(bars, ["ticker", "trading_date"]).select("ticker", F.lit("duplicate bars").alias("error"))
    broken = price_violations(bars).select("ticker", F.lit("price violation").alias("error"))
    faults = doubled.unionByName(broken).groupBy("ticker").agg(F.min("error").alias("error"))
    every = bars.select("ticker").distinct().join(faults, "ticker", "left")
    return every.select("ticker", F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("status"), "error")


def pending(tickers: DataFrame, done: DataFrame) -> DataFrame:
    """What a resumed run still has to build: tickers that no earlier run completed."""
    return tickers.join(done.where("status = 'completed'").select("ticker"), "ticker", "left_anti")


def walkforward_frame(rows: DataFrame, labelled: DataFrame, columns: list[str], horizon: int = 20) -> DataFrame:
    """Eligible rows with a complete label of the horizon, one for each key; labels can't be among the columns."""
    leaked = [c for c in columns if c.startswith("target_")]
    if leaked:
        raise ValueError(f"labels can't be features: {leaked}")
    joined = targets.training_dataset(rows, labelled, horizon)
    names = [f"target_return_{horizon}d", f"target_rank_{horizon}d", f"target_end_date_{horizon}d"]
    complete = F.col("training_eligible")
    for name in names:
        complete = complete & F.col(name).isNotNull()
    return joined.where(complete).select("ticker", "decision_date", *columns, *names)


def holdout_frame(rows: DataFrame, labelled: DataFrame, columns: list[str], test_start: date, nominal_end: date, horizon: int = 20) -> tuple[DataFrame, DataFrame]:
    """The frame up to the last test date whose labels can be observed, and one row of diagnostics of the tail beyond."""
    base = targets.eligible("model_eligible") & ~targets.eligible("feature_corporate_action_contaminated") & (F.col("decision_date") <= F.lit(nominal_end))
    joined = rows.join(labelled, ["ticker", "decision_date"]).where(base)
    end = F.col(f"target_end_date_{horizon}d")
    complete = targets.eligible(f"target_{horizon}d_training_eligible") & F.col(f"target_rank_{horizon}d").isNotNull() & (end <= F.lit(nominal_end))
    joined = joined.withColumn("_complete", F.coalesce(complete, F.lit(False)))
    last = joined.where(F.col("_complete") & (F.col("decision_date") >= F.lit(test_start))).agg(F.max("decision_date").alias("effective_test_end"))
    placed = joined.crossJoin(F.broadcast(last))  # one row
    tail = F.col("decision_date") > F.col("effective_test_end")
    found = placed.agg(
        F.max("effective_test_end").alias("effective_test_end"),
        F.count_distinct(F.when(tail, F.col("decision_date"))).alias("tail_sessions"),
        F.count_if(tail).alias("tail_rows"),
    )
    names = [f"target_return_{horizon}d", f"target_rank_{horizon}d", f"target_end_date_{horizon}d"]
    return placed.where(F.col("_complete") & ~tail).select("ticker", "decision_date", *columns, *names), found


def unexpected_nulls(rows: DataFrame, columns: list[str], warm_up: str = "percentile_volatility_252d", needed: int = 272) -> DataFrame:
    """(column, expected, unexpected) nulls of eligible rows; those of the warm-up column's first rows are expected."""
    eligible = rows.where(targets.eligible("model_eligible"))
    early = lambda c: (F.col("history_count") < needed) if c == warm_up else F.lit(False)
    sums = eligible.agg(*[x for c in columns for x in (F.count_if(F.col(c).isNull() & early(c)).alias(f"{c}__e"), F.count_if(F.col(c).isNull() & ~early(c)).alias(f"{c}__u"))])
    listed = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__e").alias("expected"), F.col(f"{c}__u").alias("unexpected")) for c in columns])
    return sums.select(F.inline(listed)).where("expected + unexpected > 0")


def ranking_diagnostics(labelled: DataFrame, least: int) -> DataFrame:
    """(horizon, decision_date, eligible, ranked, reason) of every date; a rank outside [0, 1] is an error."""
    parts = []
    for h in HORIZONS:
        rank = F.col(f"target_rank_{h}d")
        sane = F.when(rank.isNull() | rank.between(0, 1), rank).otherwise(F.raise_error(F.lit("a rank is outside [0, 1]")))
        counts = labelled.groupBy("decision_date").agg(F.count_if(targets.eligible(f"target_{h}d_training_eligible")).alias("eligible"), F.count(sane).alias("ranked"))
        reason = F.when(F.col("ranked") > 0, None).when(F.col("eligible") < least, f"insufficient_training_eligible_target_{h}d").otherwise("ranking_unavailable")
        parts.append(counts.select(F.lit(h).alias("horizon"), "decision_date", "eligible", "ranked", reason.alias("reason")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def contamination_summary(rows: DataFrame, labelled: DataFrame, events: DataFrame) -> DataFrame:
    """One row: excluded events, contaminated features and labels, and ranks that contamination cost."""
    counted = labelled.agg(
        *[F.count_if(f"target_corporate_action_contaminated_{h}d").alias(f"contaminated_targets_{h}d") for h in HORIZONS],
        F.count_if(F.col("target_corporate_action_contaminated_10d") & F.col("target_return_10d").isNotNull()).alias("rankings_excluded"),
    )
    excluded = events.agg(F.count_if("training_exclusion").alias("excluded_events"))
    features_ = rows.agg(F.count_if("feature_corporate_action_contaminated").alias("contaminated_feature_rows"))
    return excluded.crossJoin(F.broadcast(features_)).crossJoin(F.broadcast(counted))  # one row each


def explained(outliers: DataFrame, rows: DataFrame) -> DataFrame:
    """outliers with whether a contaminated feature row explains them."""
    flags = rows.select("ticker", F.col("decision_date").alias("trading_date"), targets.eligible("feature_corporate_action_contaminated").alias("explained"))
    return outliers.join(flags, ["ticker", "trading_date"], "left").withColumn("explained", F.coalesce("explained", F.lit(False)))


def split_validation(bars: DataFrame, actions: DataFrame, calendar: DataFrame, around: int = 3, limit: float = 0.30) -> DataFrame:
    """(ticker, split_date, split_factor, return_on_split, largest, passed) of every split on a session.

    The sessions around a split are seen on the basis known after them; the split passes if each has
    a return and the split day's is no larger than the limit.
    """
    seqs = calendar.select("session", "seq")
    active = asof.activation(actions.where(asof.is_split()), "effective_date", calendar).select("ticker", F.col("effective_date").alias("day"), F.col("split_factor").alias("f"), "active_seq")
    splits = actions.where(asof.is_split()).join(seqs, F.col("effective_date") == F.col("session")).select("ticker", F.col("effective_date").alias("split_date"), "split_factor", F.col("seq").alias("at"))
    last = F.max("seq").over(Window.partitionBy())  # the calendar, a small dimension
    ends = seqs.withColumn("last", last).agg(F.max("last").alias("last"))
    inside = splits.crossJoin(F.broadcast(ends)).where((F.col("at") >= around + 1) & (F.col("at") + around <= F.col("last")))  # one row
    days = inside.withColumn("seq", F.explode(F.sequence(F.col("at") - around - 1, F.col("at") + around)))
    placed = bars.join(seqs, F.col("trading_date") == F.col("session")).select("ticker", "seq", "trading_date", "close")
    window = days.join(placed, ["ticker", "seq"], "left")
    # a ticker has a few splits, so the join on it keeps the rows' number within that factor
    known = window.select("ticker", "split_date", "seq", "trading_date", "at").join(active, "ticker")
    known = known.where((F.col("active_seq") <= F.col("at") + around) & (F.col("day") > F.col("trading_date")))
    factors = known.groupBy("ticker", "split_date", "seq").agg(F.product("f").alias("f"))
    order = Window.partitionBy("ticker", "split_date").orderBy("seq")
    adjusted = window.join(factors, ["ticker", "split_date", "seq"], "left").withColumn("p", F.col("close") / F.coalesce("f", F.lit(1.0)))
    moved = adjusted.withColumn("r", F.try_divide(F.col("p"), F.lag("p").over(order)) - 1).where(F.col("seq") >= F.col("at") - around)
    found = moved.groupBy("ticker", "split_date").agg(
        F.max("split_factor").alias("split_factor"),
        F.max(F.when(F.col("seq") == F.col("at"), F.col("r"))).alias("return_on_split"),
        F.max(F.abs("r")).alias("largest"),
        F.count_if(F.col("r").isNull() & (F.col("seq") > F.col("at") - around)).alias("_missing"),
    )
    passed = (F.col("_missing") == 0) & F.coalesce(F.abs("return_on_split") <= limit, F.lit(False))
    return found.withColumn("passed", passed).drop("_missing")


def sample_checks(rows: DataFrame, bars: DataFrame, actions: DataFrame) -> DataFrame:
    """(ticker, decision_date, no_future, basis_ok): point-in-time checks of each ticker's first, middle and last row and those before splits.

    rows: ticker, decision_date, decision_time, split_adjusted_close, as built. On its own day a bar
    has no visible later split, so the built close must be the raw one.
    """
    by = Window.partitionBy("ticker").orderBy("decision_date")
    numbered = rows.withColumns({"_n": F.row_number().over(by) - 1, "_size": F.count(F.lit(1)).over(Window.partitionBy("ticker"))})
    split_days = actions.where(asof.is_split()).select("ticker", F.col("effective_date").alias("decision_date"), F.lit(1).alias("_split")).distinct()
    marks = numbered.select("ticker", "decision_date", F.lit(0).alias("_split")).unionByName(split_days)
    ahead = F.min(F.when(F.col("_split") == 1, F.col("decision_date"))).over(Window.partitionBy("ticker").orderBy(F.unix_date("decision_date")).rangeBetween(1, Window.unboundedFollowing))
    after = F.min(F.when(F.col("_split") == 0, F.col("decision_date"))).over(Window.partitionBy("ticker").orderBy(F.unix_date("decision_date")).rangeBetween(1, Window.unboundedFollowing))
    before = marks.withColumns({"_next_split": ahead, "_next_row": after}).where("_split = 0")
    before = before.where("_next_split is not null and (_next_row is null or _next_row >= _next_split)").select("ticker", "decision_date").distinct().withColumn("_before", F.lit(True))
    sample = numbered.join(before, ["ticker", "decision_date"], "left").where("_n = 0 or _n = floor(_size / 2) or _n = _size - 1 or _before")
    raw = bars.select("ticker", F.col("trading_date").alias("decision_date"), F.col("close").alias("_raw"), "available_at")
    checked = sample.join(raw, ["ticker", "decision_date"], "left")
    same = F.coalesce(F.abs(F.col("split_adjusted_close") - F.col("_raw")) <= 1e-8 + 1e-5 * F.abs("_raw"), F.lit(False))
    return checked.select("ticker", "decision_date", F.coalesce(F.col("available_at") <= F.col("decision_time"), F.lit(False)).alias("no_future"), same.alias("basis_ok"))


def target_diagnostics(rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """(horizon, valid, least, most, trailing_null, keys_without_features) of the labels."""
    lost = labelled.select("ticker", "decision_date").join(rows.select("ticker", "decision_date"), ["ticker", "decision_date"], "left_anti").agg(F.count(F.lit(1)).alias("keys_without_features"))
    back = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("decision_date")))
    numbered = labelled.withColumn("_back", back)
    sums = numbered.agg(*[x for h in HORIZONS for x in (
        F.count(f"target_return_{h}d").alias(f"v{h}"), F.min(f"target_return_{h}d").alias(f"a{h}"), F.max(f"target_return_{h}d").alias(f"b{h}"),
        (F.count_if((F.col("_back") <= h) & F.col(f"target_return_{h}d").isNotNull()) == 0).alias(f"t{h}"),
    )])
    listed = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"v{h}").alias("valid"), F.col(f"a{h}").alias("least"), F.col(f"b{h}").alias("most"), F.col(f"t{h}").alias("trailing_null")) for h in HORIZONS])
    return sums.select(F.inline(listed)).crossJoin(F.broadcast(lost))  # one row


def compared(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """(state, rows): keys that a second run lacks, adds, changes or has unchanged."""
    names = [c for c in first.columns if c not in keys]
    a = first.select(*keys, F.struct(*names).alias("_a"), F.lit(1).alias("_in_a"))
    b = second.select(*keys, F.struct(*names).alias("_b"), F.lit(1).alias("_in_b"))
    state = F.when(F.col("_in_b").isNull(), "removed").when(F.col("_in_a").isNull(), "added").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    return a.join(b, keys, "full").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("rows"))


def sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """(dataset, files, bytes) of tables that are read from files."""
    out = None
    for name, df in tables.items():
        files = df.select("_metadata.file_path", "_metadata.file_size").distinct()
        one = files.agg(F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("bytes")).select(F.lit(name).alias("dataset"), "files", "bytes")
        out = one if out is None else out.unionByName(one)
    return out


def label_faults(labelled: DataFrame, calendar: DataFrame, least: int) -> DataFrame:
    """(horizon, rows, wrong_rank, wrong_end, not_monotone): labels checked against their contract."""
    again = targets.cross_sectional_rank(labelled.drop(*[f"target_rank_{h}d" for h in HORIZONS]), least)
    ranks = again.select("ticker", "decision_date", *[F.col(f"target_rank_{h}d").alias(f"_rank_{h}") for h in HORIZONS])
    days = calendar.select(F.col("session").alias("decision_date"), F.col("seq").alias("_seq"))
    joined = labelled.join(ranks, ["ticker", "decision_date"]).join(days, "decision_date", "left")
    for h in HORIZONS:
        ends = calendar.select(F.col("session").alias(f"target_end_date_{h}d"), F.col("seq").alias(f"_end_{h}"))
        joined = joined.join(ends, f"target_end_date_{h}d", "left")
    bad = lambda h: F.col(f"target_corporate_action_contaminated_{h}d")
    wider = {5: bad(5) & ~bad(10) & F.col("target_end_date_10d").isNotNull(), 10: bad(10) & ~bad(20) & F.col("target_end_date_20d").isNotNull(), 20: F.lit(False)}
    sums = joined.agg(F.count(F.lit(1)).alias("n"), *[x for h in HORIZONS for x in (
        F.count_if(~F.col(f"target_rank_{h}d").eqNullSafe(F.col(f"_rank_{h}"))).alias(f"r{h}"),
        F.count_if(F.col(f"_end_{h}") != F.col("_seq") + h).alias(f"e{h}"), F.count_if(wider[h]).alias(f"m{h}"),
    )])
    listed = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col("n").alias("rows"), F.col(f"r{h}").alias("wrong_rank"), F.col(f"e{h}").alias("wrong_end"), F.col(f"m{h}").alias("not_monotone")) for h in HORIZONS])
    return sums.select(F.inline(listed))
