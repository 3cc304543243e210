"""Splits, segments, labels and recurrences on small hand-made histories."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, features, targets
from tidemark.operators.recurrences import smoothed

DAYS = [d.date() for d in pd.bdate_range("2025-01-02", periods=21)]


def _bars(spark, closes, days=DAYS, late=None):
    rows = [("A", d, c, c, c, c, 100.0, datetime.combine(late.get(d, d) if late else d, datetime.min.time()) + timedelta(hours=20)) for d, c in zip(days, closes)]
    return spark.createDataFrame(rows, "ticker string, trading_date date, open double, high double, low double, close double, volume double, available_at timestamp")


def _splits(spark, rows):
    return spark.createDataFrame(rows, "ticker string, effective_date date, action_type string, split_factor double, dividend_cash double, available_at timestamp")


def _calendar(spark, days=DAYS):
    return spark.createDataFrame([(d, k) for k, d in enumerate(days)], "session date, seq int")


CLOSES = [200.0] * 5 + [100.0] * 5 + [110.0] + [110.0] * 10


def test_targets_use_the_latest_basis_and_exact_sessions(spark):
    split = _splits(spark, [("A", DAYS[5], "split", 2.0, None, datetime(2025, 1, 1))])
    adjusted = asof.split_adjusted(_bars(spark, CLOSES), split)
    assert adjusted.where(F.col("trading_date") == DAYS[5]).first().cumulative_future_split_factor == 1.0
    found = {r.decision_date: r for r in targets.price_targets(adjusted, _calendar(spark)).collect()}
    assert found[DAYS[0]].target_return_10d == pytest.approx(0.10)
    assert found[DAYS[-1]].target_return_5d is None
    missing = adjusted.where(F.col("trading_date") != DAYS[10])
    assert {r.decision_date: r.target_return_10d for r in targets.price_targets(missing, _calendar(spark)).collect()}[DAYS[0]] is None


def test_an_unavailable_split_leaves_the_jump(spark):
    split = _splits(spark, [("A", DAYS[5], "split", 2.0, None, datetime(2025, 3, 1))])
    seen = asof.split_adjusted_as_of(_bars(spark, CLOSES), split, F.lit(DAYS[8]))
    assert {r.split_adjusted_close for r in seen.collect()} == {200.0, 100.0}


def test_segments_match_a_day_by_day_rebuild(spark):
    late = {DAYS[3]: DAYS[9]}
    bars = _bars(spark, [100.0 + k for k in range(21)], late=late)
    splits = _splits(spark, [("A", DAYS[6], "split", 2.0, None, datetime.combine(DAYS[8], datetime.min.time())), ("A", DAYS[12], "split", 0.5, None, datetime.combine(DAYS[12], datetime.min.time()))])
    calendar = _calendar(spark)
    history = asof.segment_histories(bars, splits, calendar).where("bar_seq between first_seq and last_seq")
    got = {r.trading_date: r.split_adjusted_close for r in history.collect()}
    for day in DAYS:
        own = {r.trading_date: r.split_adjusted_close for r in asof.split_adjusted_as_of(bars, splits, F.lit(day)).collect()}
        assert got.get(day) == own.get(day)


def test_future_rows_change_no_past_feature(spark):
    bars = _bars(spark, CLOSES)
    w = features.window()
    add = lambda df: {r.trading_date: (r.momentum_5d, r.distance_ma10) for r in df.withColumns(features.momentum(w) | features.moving_averages(w)).collect()}
    short, whole = add(bars.where(F.col("trading_date") <= DAYS[15])), add(bars)
    assert all(whole[d] == short[d] for d in short)


def test_recurrences_start_where_they_should():
    out = smoothed(pd.DataFrame({"trading_date": range(30), "close": np.linspace(100, 119, 30)}))
    assert out["rsi_14"].isna().sum() == 14 and out["rsi_14"].iloc[14] == 100.0
    assert out["macd"].iloc[0] == 0.0


def test_purge_is_strict_and_embargo_spares_training(spark):
    rows = spark.createDataFrame([("A", date(2020, 1, 1), date(2020, 1, 10), True), ("B", date(2020, 1, 2), date(2020, 1, 9), True), ("C", date(2020, 1, 10), date(2020, 1, 20), True), ("D", date(2020, 1, 12), date(2020, 1, 25), True)], "ticker string, decision_date date, end date, training_eligible boolean")
    calendar = spark.createDataFrame([(date(2020, 1, d),) for d in range(1, 31)], "session date")
    masked = targets.supervised_split(rows, "end", {"train": (date(2020, 1, 1), date(2020, 1, 9)), "test": (date(2020, 1, 10), None)}, calendar, embargo=1)
    assert {r.ticker for r in masked.where("final_train").collect()} == {"B"}
    assert {r.ticker for r in masked.where("final_test").collect()} == {"D"}
