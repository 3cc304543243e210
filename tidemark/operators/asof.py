"""Point-in-time operators: visibility filters, split factors, latest revisions, segments, contamination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.sizes import small

MARKET_ZONE = "America/New_York"
DECISION_CLOCK = "20:15:00"


def decision_time(day: Column | str, clock: str = DECISION_CLOCK, zone: str = MARKET_ZONE) -> Column:
    """The UTC instant of a decision day's cutoff in market time."""
    day = F.col(day) if isinstance(day, str) else day
    return F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", day.cast("string"), F.lit(clock))), zone)


def is_split(action: Column | str = "action_type") -> Column:
    action = F.col(action) if isinstance(action, str) else action
    return F.lower(action).endswith("split")


def is_dividend(action: Column | str = "action_type") -> Column:
    action = F.col(action) if isinstance(action, str) else action
    return F.lower(action).endswith("dividend")


def visible(df: DataFrame, date_column: str, day: Column, cutoff: Column) -> DataFrame:
    """Rows dated up to day that were available by cutoff; unknown availability isn't visible."""
    return df.where((F.col(date_column) <= day) & F.col("available_at").isNotNull() & (F.col("available_at") <= cutoff))


def extract_actions(bars: DataFrame) -> DataFrame:
    """Splits and dividends embedded in bars, one row for each key; the last ingested wins."""
    split = bars.where("split_factor <> 1.0").select("ticker", F.col("trading_date").alias("effective_date"), F.lit("split").alias("action_type"), "split_factor", F.lit(None).cast("double").alias("dividend_cash"), "available_at")
    cash = bars.where("dividend_cash > 0").select("ticker", F.col("trading_date").alias("effective_date"), F.lit("dividend").alias("action_type"), F.lit(None).cast("double").alias("split_factor"), "dividend_cash", "available_at")
    both = split.unionByName(cash)
    w = Window.partitionBy("ticker", "effective_date", "action_type").orderBy(F.desc("available_at"), F.desc("split_factor"), F.desc("dividend_cash"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def split_adjusted(bars: DataFrame, actions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Bars with cumulative_future_split_factor and split_adjusted_* columns.

    A split divides prices strictly before its effective date. Its day's factors are multiplied
    first; the factor of a bar is the product over a RANGE frame of later days, in one sort of bars
    and splits together instead of an inequality join.
    """
    keys = keys or ["ticker"]
    daily = actions.where(is_split()).groupBy(*keys, F.col("effective_date").alias("trading_date")).agg(F.product("split_factor").alias("_factor"))
    marked = bars.withColumn("_factor", F.lit(None).cast("double")).withColumn("_bar", F.lit(True))
    union = marked.unionByName(daily.withColumn("_bar", F.lit(False)), allowMissingColumns=True)
    later = Window.partitionBy(*keys).orderBy(-F.unix_date("trading_date")).rangeBetween(Window.unboundedPreceding, -1)
    factor = F.coalesce(F.product("_factor").over(later), F.lit(1.0))
    out = union.withColumn("cumulative_future_split_factor", factor).where("_bar").drop("_bar", "_factor")
    prices = {f"split_adjusted_{c}": F.col(c) / F.col("cumulative_future_split_factor") for c in ("open", "high", "low", "close")}
    return out.withColumns(prices | {"split_adjusted_volume": F.col("volume") * F.col("cumulative_future_split_factor")})


def split_adjusted_as_of(bars: DataFrame, actions: DataFrame, day: Column, clock: str = DECISION_CLOCK) -> DataFrame:
    """split_adjusted over what was visible at one day's decision time."""
    cutoff = decision_time(day, clock)
    return split_adjusted(visible(bars, "trading_date", day, cutoff), visible(actions, "effective_date", day, cutoff))


def activation(df: DataFrame, date_column: str, calendar: DataFrame) -> DataFrame:
    """df with `active_seq`, the first session on or after its date whose cutoff is not before available_at.

    calendar has session and seq. In market time a row that is available after the decision clock
    waits for the next day, so both bounds are lookups by day.
    """
    df = first_not_before(df, F.col(date_column), calendar, "_by_date")
    local = F.from_utc_timestamp("available_at", MARKET_ZONE)
    late = local > F.to_timestamp(F.concat_ws(" ", F.to_date(local).cast("string"), F.lit(DECISION_CLOCK)))
    ready = F.when(late, F.date_add(F.to_date(local), 1)).otherwise(F.to_date(local))
    df = first_not_before(df, ready, calendar, "_by_cutoff")
    known = F.col("_by_date").isNotNull() & F.col("_by_cutoff").isNotNull()
    return df.withColumn("active_seq", F.when(known, F.greatest("_by_date", "_by_cutoff"))).drop("_by_date", "_by_cutoff")


def first_not_before(df: DataFrame, day: Column, calendar: DataFrame, name: str) -> DataFrame:
    """df with the seq of the first session on or after a day, by a table of all days of the calendar."""
    before = F.lag("session").over(Window.orderBy("seq"))  # the calendar, a small dimension
    spans = calendar.select("session", "seq", F.coalesce(F.date_add(before, 1), F.col("session")).alias("_from"))
    days = spans.select(F.explode(F.sequence("_from", "session")).alias("_day"), F.col("seq").alias(name))
    first = calendar.agg(F.min("session").alias("_first"))
    placed = df.withColumn("_asked", day.cast("date")).crossJoin(F.broadcast(first))  # one row
    placed = placed.withColumn("_day", F.when(F.col("_asked").isNotNull(), F.greatest("_asked", "_first")))
    return placed.join(small(days), "_day", "left").drop("_day", "_asked", "_first")


def latest_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by order, which must be total."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def query_as_of(records: DataFrame, cutoff: Column, tickers: list[str] | None = None, use_proxy: bool = False) -> DataFrame:
    """Current revision of each article at cutoff; the ticker filter comes after the choice of revision.

    records: provider, provider_news_id, revision_id, available_at, first_seen_at, published_at,
    direct_tickers (array), and historical_proxy_at if use_proxy.
    """
    effective = F.coalesce("historical_proxy_at", "available_at") if use_proxy else F.col("available_at")
    known = records.withColumn("effective_at", effective).where(F.col("effective_at") <= cutoff)
    order = [F.desc("effective_at"), F.desc("first_seen_at"), F.desc(F.coalesce("published_at", "effective_at")), F.desc("revision_id")]
    current = latest_by_key(known, ["provider", "provider_news_id"], order)
    if tickers:
        current = current.where(F.arrays_overlap("direct_tickers", F.array(*[F.lit(t) for t in tickers])))
    return current


def effective_entries(day: Column, cutoff: Column, retrospective: bool = False) -> Column:
    """Whether a registry row (effective_from, effective_to, known_at) holds on day, its end excluded, and was known at cutoff."""
    known = F.lit(True) if retrospective else F.col("known_at") <= cutoff
    return (F.col("effective_from") <= day) & (F.col("effective_to").isNull() | (day < F.col("effective_to"))) & known


def contamination(features: DataFrame, events: DataFrame, calendar: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """features with the flag, reason and event of an excluded event within some sessions that was known by then.

    Events are spread over their window of sessions (a few rows each) and joined on equality.
    """
    seqs = calendar.select(F.col("session"), "seq")
    excluded = events.where("training_exclusion").join(seqs, F.col("event_date") == F.col("session")).drop("session")
    spread = excluded.withColumn("_seq", F.explode(F.sequence(F.col("seq") - before, F.col("seq") + after))).drop("seq")
    on = spread.join(seqs.select(F.col("seq").alias("_seq"), F.col("session").alias("decision_date")), "_seq")
    flagged = features.select("ticker", "decision_date", "decision_time").join(on, ["ticker", "decision_date"]).where("decision_time >= known_at")
    last = flagged.groupBy("ticker", "decision_date").agg(F.max_by(F.struct("event_type", "event_id"), F.struct("event_date", "source", "event_id")).alias("_event"))
    out = features.join(last, ["ticker", "decision_date"], "left")
    return out.withColumns({"feature_corporate_action_contaminated": F.col("_event").isNotNull(), "corporate_action_reason": F.col("_event.event_type"), "corporate_action_event_id": F.col("_event.event_id")}).drop("_event")


def discontinuities(adjusted: DataFrame, threshold: float = 0.30) -> DataFrame:
    """Rows whose one-day move on our own basis exceeds the threshold, with the provider's move of that day.

    A missing close is filled with the last one before moves are taken.
    """
    w = Window.partitionBy("ticker").orderBy("trading_date")
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    filled = {f"_{c}": F.last(c, ignorenulls=True).over(before) for c in ("split_adjusted_close", "adjusted_close")}
    move = lambda c: F.try_divide(F.col(c), F.lag(c).over(w)) - 1
    moves = adjusted.withColumns(filled).withColumns({"internal_return_1d": move("_split_adjusted_close"), "provider_adjusted_return_1d": move("_adjusted_close"), "prior_close": F.lag("_split_adjusted_close").over(w)})
    return moves.where(F.abs("internal_return_1d") > threshold).drop(*filled)


def detect_events(adjusted: DataFrame, actions: DataFrame, threshold: float = 0.30, continuity: float = 0.20, distribution: float = 0.10) -> DataFrame:
    """Extreme one-day moves, classified by split, distribution and provider evidence of that day.

    adjusted: ticker, trading_date, split_adjusted_close, adjusted_close, available_at.
    """
    moves = discontinuities(adjusted, threshold)
    day = actions.groupBy("ticker", F.col("effective_date").alias("trading_date")).agg(F.bool_or(is_split()).alias("_split"), F.max("dividend_cash").alias("_cash"), F.max("available_at").alias("_known"))
    joined = moves.join(day, ["ticker", "trading_date"], "left")
    gap = F.col("provider_adjusted_return_1d")
    split = F.coalesce("_split", F.lit(False))
    large = F.coalesce(F.try_divide(F.col("_cash"), F.col("prior_close")) >= distribution, F.lit(False))
    smooth = F.coalesce((F.abs(gap) <= continuity) & (F.abs(F.col("internal_return_1d") - gap) >= threshold), F.lit(False))
    kind = (
        F.when(split & (large | smooth), "complex_recapitalization")
        .when(large & smooth, "complex_distribution")
        .when(smooth, "provider_adjustment_inconsistency")
        .when(split, "split_adjustment_inconsistency")
        .otherwise("unexplained_price_discontinuity")
    )
    certainty = F.when((split & (large | smooth)) | (large & smooth), 0.95).when(smooth, 0.80).when(split, 0.70).otherwise(0.40)
    return joined.select("ticker", F.col("trading_date").alias("event_date"), kind.alias("event_type"), certainty.alias("confidence"), (split | large | smooth).alias("training_exclusion"), F.greatest("available_at", "_known").alias("known_at"))


def segments(bars: DataFrame, actions: DataFrame, calendar: DataFrame) -> DataFrame:
    """(ticker, first_seq, last_seq): runs of sessions over which a ticker's visible splits and late bars don't change.

    An activation is a split's, or a bar's that became known after its own day's cutoff.
    """
    late = bars.where(F.col("available_at") > decision_time("trading_date"))
    starts = activation(actions.where(is_split()), "effective_date", calendar).select("ticker", "active_seq")
    starts = starts.unionByName(activation(late, "trading_date", calendar).select("ticker", "active_seq")).where("active_seq is not null")
    first = bars.select("ticker").distinct().select("ticker", F.lit(0).cast("int").alias("active_seq"))
    points = starts.unionByName(first).distinct()
    last = calendar.agg(F.max("seq").alias("_last"))
    ends = F.lead("active_seq").over(Window.partitionBy("ticker").orderBy("active_seq")) - 1
    return points.crossJoin(F.broadcast(last)).select("ticker", F.col("active_seq").alias("first_seq"), F.coalesce(ends, F.col("_last")).alias("last_seq"))


def segment_histories(bars: DataFrame, actions: DataFrame, calendar: DataFrame) -> DataFrame:
    """Each segment's visible history, adjusted by the splits active in it: bars by (ticker, first_seq).

    With few splits to a ticker the blow-up over plain bars is a small factor.
    """
    found = segments(bars, actions, calendar)
    seqs = calendar.select(F.col("session").alias("trading_date"), F.col("seq").alias("bar_seq"))
    known = activation(bars, "trading_date", calendar).join(seqs, "trading_date")
    history = found.join(known, "ticker").where("bar_seq <= last_seq and active_seq <= last_seq").drop("active_seq")
    active = activation(actions.where(is_split()), "effective_date", calendar)
    splits = found.join(active, "ticker").where("active_seq <= first_seq").select("ticker", "first_seq", "effective_date", "action_type", "split_factor")
    return split_adjusted(history, splits, ["ticker", "first_seq"])
