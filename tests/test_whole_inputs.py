"""Queries read whole texts and whole tables."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from tidemark.operators import models, news
from tidemark.plans import base, build_plane, portfolio_plane, store_plane
from tidemark.sources import tables


def test_articles_hold_whole_texts(spark, tmp_path):
    head = "one headline of seven words or so"
    body = " ".join(f"w{k}" for k in range(300))
    texts = [f"{head}\n{body}\nlast words here $LATE", f"{head}\n{body}\nother end altogether", "no line break", None]
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.id: (r.headline, r.summary) for r in store_plane._articles(spark, tmp_path).collect()}
    assert got == {0: tuple(texts[0].split("\n", 1)), 1: tuple(texts[1].split("\n", 1)), 2: (texts[2], "")}
    assert {(r.id, r.matched) for r in store_plane.n03_entities(spark, tmp_path).where("evidence = 'explicit_ticker'").collect()} == {(0, "LATE")}
    assert "exact_duplicate" not in {r.relationship for r in store_plane.n05_relationships(spark, tmp_path).collect()}
    parsed = tables.parse_news(store_plane._news_lines(spark, tmp_path), "finn", F.current_timestamp())
    assert parsed.select("content_hash").distinct().count() == 4


def test_backtests_run_over_all_sessions(spark, small):
    got = portfolio_plane._runs(spark, small).where("record = 'snapshot'").groupBy("run_id").agg(F.countDistinct("session").alias("n"), F.max("session").alias("last")).collect()
    n, last = base.calendar(spark, small).agg(F.count(F.lit(1)), F.max("session")).first()
    assert len(got) == 2 and {(r.n, r.last) for r in got} == {(n, last)}


def test_models_walk_the_whole_table(spark, small, monkeypatch):
    called = {}
    years = {r.y for r in base.calendar(spark, small).select(F.year("session").alias("y")).distinct().collect()}
    walked = {r.year for r in build_plane.m04_m11_ridge_walk_forward(spark, small).collect()}
    assert walked == years - {min(years)}  # every period that has training rows
    train, test = store_plane._tree_rows(spark, small)
    last = store_plane._model_rows(spark, small).where("target_return_5d is not null").agg(F.max("decision_date")).first()[0]
    assert test.agg(F.max("decision_date")).first()[0] == last
    assert train.agg(F.max("target_end_date_5d")).first()[0] < date(1999, 1, 1) <= test.agg(F.min("decision_date")).first()[0]
    monkeypatch.setattr(models, "forest", lambda train, label, **a: called.setdefault("forest", models.ridge(train, label, 1.0)))
    store_plane.m07_forest(spark, small)
    assert "forest" in called


def test_long_aliases_are_found(spark):
    name = "The Very Long Name Of Acme Company"
    registry = spark.createDataFrame([("e", name, "s", "T", ["two words"], date(2000, 1, 1), None, datetime(2000, 1, 2))], "entity_id string, corporate_name string, security_id string, ticker string, aliases array<string>, effective_from date, effective_to date, known_at timestamp")
    rows = [(1, f"today {name} grew", "", datetime(2024, 1, 1), []), (2, "two words", "", datetime(2024, 1, 1), [])]
    articles = spark.createDataFrame(rows, "id bigint, headline string, summary string, at timestamp, tickers array<string>")
    got = {(r.id, r.matched, r.status) for r in news.resolved(articles, registry, F.lit(datetime(2030, 1, 1))).collect()}
    assert got == {(1, name, "resolved"), (2, "two words", "resolved")}
