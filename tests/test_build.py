"""Experiments against closed forms, stores, retries and news rules on small cases."""

from __future__ import annotations

from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import attribution, backtest, build, experiments, news, quality
from tidemark.sources import provider, store, tables


def test_ridges_from_sums_equal_closed_forms(spark):
    rng = np.random.default_rng(3)
    days = [date(2000 + k // 100, 1 + k // 9 % 11, 1 + k % 27) for k in range(400)]
    x = rng.normal(3, 2, (400, 2))
    y = x @ [0.5, -1.0] + rng.normal(0, 0.1, 400)
    rows = [("t", d, float(a), float(b), float(c), date(d.year, d.month, 28)) for d, (a, b), c in zip(days, x, y, strict=True)]
    df = spark.createDataFrame(rows, "ticker string, decision_date date, a double, b double, y double, ended date")
    sums = experiments.Grams(experiments.grams(df, ["a", "b"], "y", "ended"), ["a", "b"])
    for years in (None, 1):
        start = date(2003, 1, 1)
        chosen = np.array([d < start and (years is None or d.year >= 2002) for d in days])
        intercept, found = experiments.ridge(sums.training(start, years), [0, 1], 2.0)
        mean, spread = x[chosen].mean(0), x[chosen].std(0)
        z = (x[chosen] - mean) / spread
        beta = np.linalg.solve(z.T @ z + 2.0 * np.eye(2), z.T @ (y[chosen] - y[chosen].mean())) / spread
        assert found == pytest.approx(beta) and intercept == pytest.approx(y[chosen].mean() - beta @ mean)
    fitted = experiments.fits(sums, [date(2003, 1, 1)], {"all": (None, ["a", "b"]), "one": (None, ["b"])}, 2.0)
    assert fitted[1][4][0] == 0.0
    got = {(r.policy, r.decision_date): r.prediction for r in experiments.predictions(df, ["a", "b"], fitted).collect()}
    late = next(r for r in rows if r[1].year == 2003)
    intercept, found = fitted[0][3], fitted[0][4]
    assert got["all", late[1]] == pytest.approx(intercept + found[0] * late[2] + found[1] * late[3]) and min(d for _, d in got).year == 2003


def test_sums_of_nothing():
    assert experiments.ridge(np.zeros((4, 4)), [0, 1], 1.0)[0] == 0.0


def test_holdouts_open_once(spark, tmp_path):
    path = str(tmp_path / "opening")
    assert experiments.open_once(spark, path, {"a": 1}) == "first_official_evaluation"
    assert experiments.open_once(spark, path, {"a": 1}) == "exact_reproduction"
    with pytest.raises(ValueError):
        experiments.open_once(spark, path, {"a": 2})


def test_tables_are_replaced_whole(spark, tmp_path):
    root = str(tmp_path / "table")
    assert store.current_table(spark, root, "id bigint").isEmpty()
    store.replace_table(spark.range(3), root)
    store.replace_table(store.current_table(spark, root, "id bigint").where("id > 0"), root)
    assert sorted(r.id for r in store.current_table(spark, root, "id bigint").collect()) == [1, 2]
    store.write_sidecar(spark, f"{root}.json", {"b": 1, "a": date(2000, 1, 1)})
    assert store.read_sidecar(spark, f"{root}.json") == {"a": "2000-01-01", "b": 1}


def test_snapshots_have_content_ids(spark, tmp_path):
    inputs = spark.createDataFrame([(1,), (2,)], "id bigint")
    clusters = spark.createDataFrame([([1, 2],)], "members array<bigint>")
    parts = {"inputs": inputs, "entity_links": inputs, "clusters": clusters, "pair_evidence": inputs.limit(0)}
    first = store.write_snapshot(parts, str(tmp_path), {"cutoff": "c"})
    assert store.write_snapshot(parts | {"inputs": inputs.repartition(3)}, str(tmp_path), {"cutoff": "c"}) == first
    assert store.write_snapshot(parts | {"inputs": inputs.unionByName(inputs)}, str(tmp_path), {"cutoff": "c"}) != first
    faults = store.partition_faults(inputs, clusters, inputs).first()
    assert (faults.inputs, faults.members, faults.in_none, faults.in_several, faults.unknown_members, faults.unknown_links) == (2, 2, 0, 0, 0, 0)


def test_errors_of_stores(spark):
    with pytest.raises(ValueError):
        store.universe(spark, "spy", ["a", " A"])
    with pytest.raises(ValueError):
        store.refuse_collisions(spark.createDataFrame([("h", "a"), ("h", "b")], "payload_hash string, payload string"))
    records = spark.createDataFrame([("r", "x")], "revision_id string, raw_hash string")
    with pytest.raises(ValueError):
        store.lineage(records, spark.createDataFrame([("h", 1)], "payload_hash string, capture_id int"))


def test_retries_wait_longer_each_time():
    waits, calls = [], iter([provider.Throttled(5.0), OSError("down"), None])

    def call():
        error = next(calls)
        if error:
            raise error
        return "bars"

    assert provider.with_retries(call, 3, 0.5, waits.append) == "bars" and waits == [5.0, 1.0]
    with pytest.raises(OSError):
        provider.with_retries(lambda: (_ for _ in ()).throw(OSError("down")), 2, 0.0, waits.append)


HEADS = [
    (1, "Apple iPhone16 demand falls in China as sluggish demand spreads", "a", None),
    (2, "Apple iPhone 16 demand falls in China as soft demand spreads - Nikkei", "a", None),
    (3, "Apple iPhone 17 demand falls in China as soft demand spreads", "a", None),
    (4, "Apple iPhone 16 demand falls in China as soft demand spreads", "b", None),
    (5, "Apple iPhone 16 demand falls in China as soft demand spreads", "a", date(2024, 1, 2)),
    (6, "Apple iPhone 16 demand falls in China as soft demand spreads", "a", date(2024, 1, 3)),
]


def test_editorial_rules(spark):
    rows = [(i, h, "", datetime(2024, 1, 2), [t], [t], d) for i, h, t, d in HEADS]
    articles = spark.createDataFrame(rows, "id bigint, headline string, summary string, at timestamp, tickers array<string>, entities array<string>, event_date date")
    ready = news.prepared_editorial(articles)
    pairs = articles.select(F.col("id").alias("left_id")).crossJoin(articles.select(F.col("id").alias("right_id"))).where("left_id < right_id")
    found = {(r.left_id, r.right_id): r.relationship for r in news.classified_editorial(pairs, ready).collect()}
    assert found[1, 2] == "editorial_duplicate"  # spacing, synonym and credit are editorial
    assert found[2, 3] == "different"  # another product generation
    assert found[4, 5] == "different"  # other tickers and no common entity
    assert found[5, 6] == "different"  # other event dates
    assert {r.relationship for r in news.classified(pairs.where("left_id = 5 and right_id = 6"), ready.withColumn("event_date", F.lit(None).cast("date"))).collect()} == {"exact_duplicate"}


def test_groups_of_long_chains(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    n = 40
    articles = spark.createDataFrame([(k, datetime(2024, 1, 1, 0, k)) for k in range(n)], "id bigint, at timestamp")
    pairs = spark.createDataFrame([(k, k + 1, "exact_duplicate") for k in range(n - 1)], "left_id bigint, right_id bigint, relationship string")
    got = {r.id: r.representative for r in news.groups(articles, pairs, ["exact_duplicate"]).collect()}
    assert got == {k: k // 2 * 2 for k in range(n)}  # complete links only


def test_attribution_frames(spark):
    cases = [
        ("A+B", "C", "A+B has acquired C.", "direct_participant", "buyer", "transaction", "ma", "reported", []),
        ("C", "A+B", "A+B has acquired C.", "direct_participant", "target", "transaction", "ma", "reported", []),
        ("A+B", "C", "A+B may acquire C.", "direct_participant", "buyer", "transaction", "ma", "reported", ["attribution_state_conflict", "relation_not_stated"]),
        ("A", None, "A issued bonds.", "direct_participant", "issuer", "transaction", "financing", "reported", []),
        ("A", "C", "AA sued C", "direct_participant", "legal_subject", "litigation", "litigation", "reported", ["relation_not_stated"]),
        ("A", None, "A is here", "contextual_mention", "unknown", "unknown", "ma", "unknown", []),
        ("A", "B", None, "supported_indirect", "unknown", "competition", "ma", "reported", ["attribution_evidence_required"]),
    ]
    df = spark.createDataFrame([(k, *c[:-1]) for k, c in enumerate(cases)], "k int, name string, peer string, quote string, attribution string, role string, relation string, event_type string, state string")
    assert [r.faults for r in sorted(attribution.attribution_faults(df).select("k", "faults").collect())] == [c[-1] for c in cases]


def test_failing_runs_are_isolated(spark):
    bad = spark.createDataFrame([("r", "session", date(2000, 1, 3)), ("r", "target", date(2000, 1, 3))], "run_id string, kind string, session date")
    runs = spark.createDataFrame([("r",)], "run_id string")
    calendar = spark.createDataFrame([(date(2000, 1, 3),), (date(2000, 1, 4),)], "session date")
    targets = spark.createDataFrame([("r", date(2000, 1, 3), "x", 1.0)], "run_id string, decision_date date, ticker string, weight double")
    bars = spark.createDataFrame([("y", date(2000, 1, 3), 1.0, 1.0)], "ticker string, trading_date date, open double, close double")
    actions = spark.createDataFrame([], "ticker string, effective_date date, action_type string, split_factor double, dividend_cash double")
    assert bad.count() == 2
    found = backtest.run_all(backtest.inputs(runs, calendar, bars, actions, targets), isolate=True).collect()
    assert [(r.record, r.status) for r in found] == [("failure", "ValueError")]


def test_rare_pool_comes_first(spark):
    df = spark.range(20).withColumnRenamed("id", "doc_id").withColumn("lang", F.when(F.col("doc_id") >= 15, "xx").otherwise("en"))
    got = [r.doc_id for r in quality.rare_first(df, F.col("lang") == "xx", ["doc_id"], 6, 3).collect()]
    assert got == [15, 16, 17, 0, 1, 2]


def test_compared_runs(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "k int, v double")
    b = spark.createDataFrame([(2, None), (3, 4.0), (4, 0.0)], "k int, v double")
    assert {r.state: r.rows for r in build.compared(a, b, ["k"]).collect()} == {"removed": 1, "same": 1, "changed": 1, "added": 1}


def test_parsed_bars_keep_their_split_default(spark):
    lines = spark.createDataFrame([('{"date": "2000-01-03T00", "close": 2.0}',), ("{}",)], "value string")
    assert [(r.ticker, r.close, r.split_factor) for r in tables.parse_bars(lines, "t").collect()] == [("t", 2.0, 1.0)]
