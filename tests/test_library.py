"""Text functions, stores, news rules, risk and extraction checks on small cases."""

from __future__ import annotations

import math
import random
from collections import Counter
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import text
from tidemark.operators import allocation, extraction, metrics, news
from tidemark.operators.news import complete_link
from tidemark.sources import tables


def bag_cosine(a, b):
    x, y = (Counter([*t, *zip(t, t[1:], strict=False)]) for t in (a, b))
    size = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(x[k] * y[k] for k in x) / size if size else 0.0


def test_links_and_words(spark):
    urls = ["HTTPS://Ex.com/a?b=2&utm_source=x&a=1#f", "ftp://x/y", None, "http://x?q=&r=a%20b", "http://X/p?z=%zz&GCLID=1", "http:///a", ""]
    rows = spark.createDataFrame(list(enumerate(urls)), "id int, url string").select("id", C.link(F.col("url")).alias("link")).collect()
    assert [r.link for r in sorted(rows)] == ["https://ex.com/a?a=1&b=2", None, None, "http://x?r=a+b", "http://x/p?z=%25zz", None, None]
    texts = ["Ａpple isn't STRASSE ß", "plain_1 Text", None, ""]
    found = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", C.words(F.col("t")).alias("w")).collect()
    assert [r.w for r in sorted(found)] == [["apple", "isn", "t", "strasse", "ss"], ["plain_1", "text"], [], []]


def test_bags_and_runs():
    rnd = random.Random(6)
    a, b = ([[rnd.choice("abc") for _ in range(rnd.randint(0, 8))] for _ in range(60)] for _ in range(2))
    a, b = [None, *a], [["a"], *b]
    assert text.cosine(pd.Series(a), pd.Series(b)).tolist() == pytest.approx([bag_cosine(x or [], y) for x, y in zip(a, b, strict=True)])
    longest = [max([0, *(n for n in range(1, 9) if {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} & {tuple(y[k : k + n]) for k in range(len(y) - n + 1)})]) for x, y in ((x or [], y) for x, y in zip(a, b, strict=True))]
    assert text.longest_run(pd.Series(a), pd.Series(b)).tolist() == longest
    assert text.cosine(pd.Series([], dtype=object), pd.Series([], dtype=object)).empty
    assert text.repeats_a_key(pd.Series(['{"a": 1, "a": 2}', '{"a": {"b": 1}}', "{", None])).tolist() == [True, False, None, None]
    with pytest.raises(ValueError):
        text.strict_json('{"a": 1, "a": 2}')


def test_labels_are_refused_as_features(spark):
    with pytest.raises(ValueError):
        tables.feature_range(spark.range(1), None, None, ["target_rank_5d"])


def test_complete_link_is_not_transitive(spark):
    import pandas as pd

    group = pd.DataFrame({"id": [1, 2, 3], "rank": ["1", "2", "3"], "matches": [[2], [1, 3], [2]]})
    assert complete_link(group).values.tolist() == [[1, 1, 2], [2, 1, 2], [3, 3, 1]]


def test_pair_rules(spark):
    when = datetime(2024, 1, 1)
    rows = [(1, "Acme launches new watch in Paris today", "", when), (2, "Acme launches new watch in Paris", "", when), (3, "Acme launches new tablet in Paris today", "", when), (4, "Acme launches new watch in Paris today", "", when)]
    articles = spark.createDataFrame(rows, "id bigint, headline string, summary string, at timestamp").withColumn("entities", F.array(F.lit("acme")))
    prepared = news.prepared(articles)
    found = {(r.left_id, r.right_id): r.relationship for r in news.classified(news.blocked_pairs(prepared, [F.lit("k")]), prepared).collect()}
    assert found[1, 4] == "exact_duplicate" and found[1, 3] == "different" and found[1, 2] in ("editorial_duplicate", "shared_event")


def test_candidate_budget(spark):
    articles = spark.createDataFrame([(k, datetime(2024, 1, 1)) for k in range(5)], "id bigint, at timestamp")
    with pytest.raises(ValueError):
        news.blocked_pairs(articles, [F.lit("k")], budget=3)


def test_quote_and_number_checks(spark):
    df = spark.createDataFrame([("aaa", "aa"), ("abc", "bc"), ("abc", "x")], "t string, q string")
    assert [r.s.status for r in df.select(extraction.locate(F.col("q"), F.col("t")).alias("s")).collect()] == ["ambiguous", "resolved", "absent"]
    rows = spark.createDataFrame([("1,200", 1200, "rose to 1,200 million"), ("12", 12, "rose to 1,200 million")], "v string, n int, quote string")
    none = F.lit(None).cast("string")
    faults = [r.f for r in rows.select(extraction.number_faults(F.col("v"), F.col("n").cast("decimal(38,18)"), F.col("quote"), none, F.lit("million"), none).alias("f")).collect()]
    assert faults == [[], ["number_absent_from_context"]]


def test_risk_and_confusion(spark):
    weights = spark.createDataFrame([(1, "A", 0.2), (1, "B", 0.05), (2, "A", -0.1)], "decision_date int, ticker string, weight double")
    assert {(r.decision_date, r.action) for r in allocation.risk_check(weights).collect()} == {(1, "REDUCE"), (2, "BLOCK")}
    empty = metrics.confusion(weights.where("weight > 1"), F.col("weight") > 0, F.col("weight") > 0).first()
    assert empty.tp == 0 and empty.precision is None


def test_performance_of_a_known_series(spark):
    nav = spark.createDataFrame([("x", datetime(2024, 1, d).date(), v) for d, v in ((1, 100.0), (2, 120.0), (3, 90.0), (4, 130.0))], "run_id string, as_of date, nav double")
    r = metrics.portfolio(nav, ["run_id"]).first()
    assert r.max_drawdown == pytest.approx(-0.25) and (r.peak_date.day, r.trough_date.day, r.recovery_date.day) == (2, 3, 4)
