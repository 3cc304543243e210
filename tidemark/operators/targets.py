"""Forward-return labels, cross-sectional ranks, supervised splits and walk-forward schedules."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import first_not_before
from tidemark.operators.windows import percentile_rank

HORIZONS = (5, 10, 20)


def price_targets(adjusted: DataFrame, calendar: DataFrame, events: DataFrame | None = None, horizons=HORIZONS) -> DataFrame:
    """Returns h calendar sessions ahead; a missing bar on that session gives null, never the next bar.

    adjusted: ticker, trading_date, split_adjusted_close. events: ticker, event_date, training_exclusion.
    All horizons come from one sort by session number: the price at seq + h is a RANGE frame of that
    one number, and an excluded event contaminates a label if it falls on sessions seq + 1 to seq + h.
    """
    ends = Window.orderBy("seq")  # the calendar, a small dimension
    days = calendar.select("session", "seq", *[F.lead("session", h).over(ends).alias(f"target_end_date_{h}d") for h in horizons])
    rows = adjusted.select("ticker", F.col("trading_date").alias("decision_date"), F.col("split_adjusted_close").alias("_price"))
    rows = rows.join(days.withColumnRenamed("session", "decision_date"), "decision_date", "left").withColumn("_event", F.lit(0))
    if events is not None:
        marked = events.where("training_exclusion").select("ticker", "event_date").distinct()
        placed = first_not_before(marked, F.col("event_date"), calendar, "seq").where("seq is not null")
        rows = rows.unionByName(placed.select("ticker", "seq", F.lit(1).alias("_event")), allowMissingColumns=True)
    ahead = Window.partitionBy("ticker").orderBy("seq")
    known, out = F.col("seq").isNotNull(), rows
    for h in horizons:
        future = F.when(known, F.max("_price").over(ahead.rangeBetween(h, h)))
        hit = F.when(known & F.col(f"target_end_date_{h}d").isNotNull(), F.max("_event").over(ahead.rangeBetween(1, h)) == 1)
        value = F.try_divide(future, F.col("_price")) - 1
        out = out.withColumns({f"target_return_{h}d": value, f"target_corporate_action_contaminated_{h}d": F.coalesce(hit, F.lit(False))})
    out = out.where("_event = 0")
    for h in horizons:
        value, bad = F.col(f"target_return_{h}d"), F.col(f"target_corporate_action_contaminated_{h}d")
        out = out.withColumns({f"target_positive_{h}d": (value > 0).cast("int"), f"target_{h}d_training_eligible": value.isNotNull() & ~bad})
    return out.drop("_price", "seq", "_event")


def cross_sectional_rank(targets: DataFrame, least: int = 20, horizons=HORIZONS) -> DataFrame:
    """Rank each date's eligible returns to [0, 1], ties averaged; null where a date has fewer than least."""
    for h in horizons:
        value = F.when(F.coalesce(f"target_{h}d_training_eligible", F.lit(False)), F.col(f"target_return_{h}d"))
        targets = targets.withColumn("_value", value).withColumn(f"target_rank_{h}d", percentile_rank(F.col("_value"), ["decision_date"], least)).drop("_value")
    return targets


def assert_unique(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df, after a check that no key repeats."""
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"{name} has duplicate keys")
    return df


def training_dataset(features: DataFrame, targets: DataFrame, horizon: int = 10) -> DataFrame:
    """Features and targets joined one to one, with training_eligible."""
    if horizon not in HORIZONS:
        raise ValueError("horizon must be 5, 10, or 20")
    joined = features.join(targets, ["ticker", "decision_date"])
    return joined.withColumn("training_eligible", eligible("model_eligible") & ~eligible("feature_corporate_action_contaminated") & eligible(f"target_{horizon}d_training_eligible"))


def eligible(name: str) -> Column:
    """A nullable flag, null as false."""
    return F.coalesce(F.col(name).cast("boolean"), F.lit(False))


def supervised_split(joined: DataFrame, end_column: str, splits: dict[str, tuple[date, date | None]], calendar: DataFrame, embargo: int = 0) -> DataFrame:
    """joined with masks in_{split}, eligible_{split}, purged_{split} and final_{split}.

    splits: name -> (first day, last day or None), in order. A row is purged if its label ends on or
    after the next split's first day; the first embargo sessions of later splits are left out.
    """
    names = list(splits)
    for k, name in enumerate(names):
        first, last = splits[name]
        inside = (F.col("decision_date") >= F.lit(first)) & (F.lit(True) if last is None else F.col("decision_date") <= F.lit(last))
        joined = joined.withColumn(f"in_{name}", inside).withColumn(f"eligible_{name}", F.col(f"in_{name}") & eligible("training_eligible"))
        keep = F.col(f"eligible_{name}")
        if k + 1 < len(names):
            keep = keep & F.coalesce(F.col(end_column) < F.lit(splits[names[k + 1]][0]), F.lit(False))
        joined = joined.withColumn(f"purged_{name}", keep)
        if k and embargo:
            stop = calendar.where(F.col("session") >= F.lit(first)).orderBy("session").limit(embargo).agg(F.max("session").alias("_stop"))
            joined = joined.crossJoin(F.broadcast(stop)).withColumn(f"final_{name}", F.col(f"purged_{name}") & ~F.coalesce((F.col("decision_date") >= F.lit(first)) & (F.col("decision_date") <= F.col("_stop")), F.lit(False))).drop("_stop")
        else:
            joined = joined.withColumn(f"final_{name}", F.col(f"purged_{name}"))
    return joined


def split_manifest(masked: DataFrame, names: list[str]) -> DataFrame:
    """One row: rows of each split at each stage."""
    return masked.agg(*[F.count_if(f"{stage}_{name}").alias(f"{stage}_{name}") for name in names for stage in ("in", "eligible", "purged", "final")])


#: The first day of a session's period, by retraining frequency.
PERIOD = {
    "monthly": "trunc(session, 'MM')",
    "quarterly": "trunc(session, 'QUARTER')",
    "semiannual": "make_date(year(session), case when month(session) <= 6 then 1 else 7 end, 1)",
    "annual": "trunc(session, 'YEAR')",
}


def walkforward_schedule(calendar: DataFrame, frequency: str) -> DataFrame:
    """(sequence, prediction_start, prediction_end, sessions): sessions grouped by period."""
    if frequency not in PERIOD:
        raise ValueError(f"unsupported retraining frequency: {frequency}")
    periods = calendar.groupBy(F.expr(PERIOD[frequency]).alias("period")).agg(F.min("session").alias("prediction_start"), F.max("session").alias("prediction_end"), F.count(F.lit(1)).alias("sessions"))
    return periods.select(F.row_number().over(Window.orderBy("period")).alias("sequence"), "prediction_start", "prediction_end", "sessions")


def schedule_faults(schedule: DataFrame, calendar: DataFrame) -> DataFrame:
    """One row: sessions, those that periods cover, overlaps, and periods whose edges are no sessions of theirs."""
    edges = schedule.select(F.explode(F.array("prediction_start", "prediction_end")).alias("session"))
    listed = edges.join(calendar.select("session", "seq"), "session", "left")
    order = Window.orderBy("prediction_start")  # a schedule is a few rows
    pairs = schedule.withColumn("_next", F.lead("prediction_start").over(order)).agg(F.count_if(F.col("_next") <= F.col("prediction_end")).alias("overlaps"), F.sum("sessions").alias("covered"))
    stray = listed.agg(F.count_if(F.col("seq").isNull()).alias("edges_outside"))
    return calendar.agg(F.count(F.lit(1)).alias("sessions")).crossJoin(F.broadcast(pairs)).crossJoin(F.broadcast(stray))  # one row each


def training_counts(rows: DataFrame, schedule: DataFrame, frequency: str, end_column: str) -> DataFrame:
    """(sequence, rows, last_label) of each period's training set: rows whose labels ended before its first session.

    A row joins with the period after the one its label ends in and stays, so the sets are running sums.
    """
    period = lambda c: F.expr(PERIOD[frequency].replace("session", c))
    periods = schedule.select("sequence", period("prediction_start").alias("period"))
    ready = rows.groupBy(period(end_column).alias("period")).agg(F.count(F.lit(1)).alias("n"), F.max(end_column).alias("last"))
    joined = periods.join(ready, "period").select((F.col("sequence") + 1).alias("sequence"), "n", "last")
    before = Window.orderBy("sequence")  # a schedule is a few rows
    sums = schedule.select("sequence").join(joined, "sequence", "left").select("sequence", F.sum("n").over(before).alias("rows"), F.max("last").over(before).alias("last_label"))
    return sums.where("rows is not null")


def training_window(rows: DataFrame, start: Column, nominal_end: Column, prediction_start: Column, end_column: str) -> DataFrame:
    """Rows to fit on: dated in [start, nominal_end] with labels that end before the first prediction."""
    return rows.where(F.col("decision_date").between(start, nominal_end) & (F.col(end_column) < prediction_start))


def model_age(calendar: DataFrame, schedule: DataFrame) -> DataFrame:
    """(session, sequence, sessions_since_fit, bucket) of each session in its period."""
    placed = calendar.join(schedule, calendar["session"].between(schedule["prediction_start"], schedule["prediction_end"]))
    age = F.row_number().over(Window.partitionBy("sequence").orderBy("session")) - 1
    bucket = F.when(age <= 20, "0-20").when(age <= 40, "21-40").when(age <= 60, "41-60").when(age <= 120, "61-120").otherwise("121+")
    return placed.select("session", "sequence", age.alias("sessions_since_fit"), bucket.alias("bucket"))
