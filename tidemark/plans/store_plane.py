"""Sources, upserts, quality, news, extraction checks, models and streams over the driver's tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions.sizes import small
from tidemark.operators import extraction, features, metrics, models, news, quality, targets
from tidemark.operators.asof import effective_entries, split_adjusted
from tidemark.plans import base
from tidemark.session import shared_dir, written
from tidemark.sources import tables
from tidemark.streaming import late_data

START, END = date(1996, 1, 1), date(1996, 12, 31)


def sc01_sql(spark, sf_dir):
    base.read(spark, sf_dir, "orders").createOrReplaceTempView("tm_orders")
    return tables.query(spark, "select o_orderstatus, count(*) as orders, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total from tm_orders where o_totalprice > ? group by 1", [1000.0])


def sc04_filtered_scan(spark, sf_dir):
    return tables.scan(spark, f"{sf_dir}/orders.parquet", [("o_orderstatus", "in", ["F", "P"]), ("o_totalprice", ">=", 100000.0)], ["o_orderkey", "o_orderstatus"])


def _ingested(spark, sf_dir):
    bars = base.bars(spark, sf_dir).select("ticker", "trading_date", "close").withColumn("provider", F.lit("p"))
    old = bars.withColumn("ingested_at", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    new = bars.where("trading_date >= date '1999-01-01'").withColumn("close", F.col("close") * 2).withColumn("ingested_at", F.to_timestamp(F.lit("2024-02-01 00:00:00")))
    return old, new


def sc06_upsert(spark, sf_dir):
    old, new = _ingested(spark, sf_dir)
    return tables.upsert(old, new, tables.BAR_KEY).select("ticker", "trading_date", "close", "ingested_at")


def sc07_replace_dates(spark, sf_dir):
    old = base.actions(spark, sf_dir).withColumn("ingested_at", F.lit(1))
    incoming = old.where("action_type = 'split' and effective_date >= date '1998-01-01'").withColumn("ingested_at", F.lit(2))
    refreshed = old.where("effective_date >= date '1998-01-01'")
    return tables.replace_dates(old, incoming, refreshed, ["ticker", "effective_date", "action_type"]).select("ticker", "effective_date", "action_type", "ingested_at")


def sc08_latest_date(spark, sf_dir):
    return base.bars(spark, sf_dir).groupBy("ticker").agg(F.max("trading_date").alias("latest"))


def sc11_replace_range(spark, sf_dir):
    rows = base.bars(spark, sf_dir).select("ticker", F.col("trading_date").alias("decision_date"), "close")
    incoming = rows.where(F.col("decision_date").between(F.lit(START), F.lit(END)) & (F.dayofweek("decision_date") == 2) & F.col("ticker").isin("NATION_1", "NATION_2"))
    return tables.replace_range(rows, incoming, ["NATION_1", "NATION_2"], START, END).groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"))


def sc12_feature_range(spark, sf_dir):
    rows = base.bars(spark, sf_dir).select("ticker", F.col("trading_date").alias("decision_date"), "close", "volume").withColumn("year", F.year("decision_date"))
    return tables.feature_range(rows, START, END, ["close", "close"], ["NATION_1", "NATION_7"])


def _records(spark, sf_dir):
    e = base.read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("news_id"), F.concat_ws("-", "user_id", "event_type").alias("revision_id"), F.lit("1").alias("schema_version"), F.lit("1").alias("normalizer_version"), F.col("ts").alias("first_seen_at"), F.col("ts").alias("ingested_at"), F.sha2(F.col("event_id").cast("string"), 256).alias("raw_hash"), "event_id")


def sc17_records(spark, sf_dir):
    rows = _records(spark, sf_dir)
    return tables.earliest_records(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")).select("revision_id", "first_seen_at", "raw_hash")


def sc19_migrated(spark, sf_dir):
    e = base.read(spark, sf_dir, "events").select("event_id", F.col("ts").alias("available_at"), (F.col("ts") + F.expr("interval 1 day")).alias("first_seen_at"), F.when(F.col("event_id") % 3 == 0, "published_at_proxy").otherwise("captured").alias("availability_basis"), F.lit(None).cast("timestamp").alias("historical_proxy_at"))
    return tables.migrated(e).select("event_id", "available_at", "historical_proxy_at")


def sc15_sc21_integrity(spark, sf_dir):
    rows = _records(spark, sf_dir)
    payloads = rows.where("event_id % 5 <> 0").select(F.col("event_id").cast("string").alias("payload"), F.col("first_seen_at").alias("captured_at"))
    captures = tables.raw_captures(payloads, payloads.limit(0).withColumn("payload_hash", F.lit("")))
    return tables.integrity(rows, captures)


def sc23_parse_bars(spark, sf_dir):
    bars = base.bars(spark, sf_dir)
    lines = bars.select("ticker", F.to_json(F.struct(F.concat(F.col("trading_date").cast("string"), F.lit("T00:00:00.000Z")).alias("date"), "open", "high", "low", "close", "volume", F.col("close").alias("adjClose"), F.lit(0.0).alias("splitFactor"))).alias("value"))
    return tables.parse_bars(lines, F.col("ticker")).select("ticker", "trading_date", F.round("close", 6).alias("close"), "split_factor", "dividend_cash")


def _first_line():
    return F.substring_index("text", "\n", 1)


def _after_first_line():
    return F.substring(F.col("text"), F.length(_first_line()) + 2, F.length("text"))


def _news_lines(spark, sf_dir):
    docs = base.read(spark, sf_dir, "documents")
    return docs.select(F.to_json(F.struct(F.col("doc_id").alias("id"), _first_line().alias("headline"), F.coalesce(_after_first_line(), F.lit("")).alias("summary"), F.col("source").alias("url"), (F.lit(1700000000) + F.col("doc_id")).alias("datetime"), F.concat_ws(",", "lang", "source", "lang").alias("related"))).alias("value"))


def sc25_parse_news(spark, sf_dir):
    parsed = tables.parse_news(_news_lines(spark, sf_dir), "finn", F.to_timestamp(F.lit("2023-11-14 22:20:00")))
    return parsed.select("news_id", F.array_join("direct_tickers", ",").alias("direct_tickers"), "available_at")


def sc29_symbols(spark, sf_dir):
    aliases = spark.createDataFrame([("NATION_1", "N.1"), ("NATION_2", "N.2")], "ticker string, provider_symbol string")
    return tables.internal_symbols(base.read(spark, sf_dir, "nation").select(F.col("n_name").alias("ticker")), aliases)


def q01_duplicates(spark, sf_dir):
    return quality.duplicate_keys(base.read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def q02_violations(spark, sf_dir):
    """Violations in bars of which every seventh day of a month has been spoilt."""
    spoilt = F.dayofmonth("trading_date") == 7
    bars = base.bars(spark, sf_dir).withColumns({"high": F.when(spoilt, F.col("low") / 2).otherwise(F.col("high")), "volume": F.when(F.dayofmonth("trading_date") == 8, -F.col("volume")).otherwise(F.col("volume"))})
    return quality.price_violations(bars).select("ticker", "trading_date")


def w25_gaps(spark, sf_dir):
    return quality.session_gaps(base.bars(spark, sf_dir), base.calendar(spark, sf_dir))


def a11_diagnostics(spark, sf_dir):
    return quality.ticker_diagnostics(base.bars(spark, sf_dir))


def a10_coverage(spark, sf_dir):
    return quality.coverage(base.bars(spark, sf_dir).where("volume > 30"), base.calendar(spark, sf_dir), "trading_date")


def _moves(spark, sf_dir):
    w = features.window()
    bars = base.bars(spark, sf_dir).withColumns(features.returns(w)).withColumns(features.true_range(w)).withColumns(features.volumes(w))
    bars = bars.withColumns(features.volatility(w)).withColumns(features.average_true_range(w))
    return bars.select("ticker", "trading_date", *[F.round(c, 6).alias(c) for c in quality.OUTLIERS])


def q06_outliers(spark, sf_dir):
    return quality.outliers(_moves(spark, sf_dir))


def a12_health(spark, sf_dir):
    return quality.column_health(_moves(spark, sf_dir), list(quality.OUTLIERS)).withColumn("null_share", F.round("null_share", 9))


def t04_extremes(spark, sf_dir):
    rows = base.bars(spark, sf_dir).select("ticker", "trading_date", "close")
    return quality.extremes(rows, "close")


def t07_round_robin(spark, sf_dir):
    return quality.round_robin(base.read(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", ["doc_id"], 50)


def a13_counts(spark, sf_dir):
    return base.read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def a18_costs(spark, sf_dir):
    e = base.read(spark, sf_dir, "events").select("event_type", F.dayofmonth("ts").alias("day"), F.when(F.col("event_id") % 10 > 0, F.col("value").cast("decimal(18,2)")).alias("cost"))
    return extraction.costs(e, ["event_type", "day"]).withColumn("cost", F.col("cost").cast("double"))


def l03_quotes(spark, sf_dir):
    docs = base.read(spark, sf_dir, "documents").select("doc_id", "text", F.substring("text", 5, 12).alias("quote"))
    return docs.select("doc_id", extraction.locate(F.col("quote"), F.col("text")).alias("q")).select("doc_id", "q.status", F.col("q.start").alias("first"))


def x02_links(spark, sf_dir):
    return base.read(spark, sf_dir, "pages").select("page_id", C.link(F.col("url")).alias("link"))


def x03_ids(spark, sf_dir):
    return base.read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat_ws("\u0000", F.lit("news"), "source", F.col("doc_id").cast("string")), 256).alias("news_id"))


def x04_decision_time(spark, sf_dir):
    from tidemark.operators.asof import decision_time

    return base.calendar(spark, sf_dir).select("session", decision_time("session").alias("cutoff"), C.period_key(F.col("session"), "quarterly").alias("quarter"))


def _registry(spark):
    rows = [("e1", "The", "s1", "src1", ["hat"], date(2000, 1, 1), None), ("e1", "The", "s2", "src2", [], date(2000, 1, 1), date(2024, 1, 1)), ("e2", "Anan", "s3", "src3", ["the"], date(2000, 1, 1), None)]
    df = spark.createDataFrame(rows, "entity_id string, corporate_name string, security_id string, ticker string, aliases array<string>, effective_from date, effective_to date")
    return df.withColumn("known_at", F.to_timestamp(F.lit("2001-01-01 00:00:00")))


def f16_registry(spark, sf_dir):
    days = base.read(spark, sf_dir, "events").select(F.to_date("ts").alias("day")).distinct()
    return days.join(small(_registry(spark)), effective_entries(F.col("day"), F.col("day").cast("timestamp"))).select("day", "security_id")


def _articles(spark, sf_dir):
    docs = base.read(spark, sf_dir, "documents").where("text is not null")
    return docs.select(F.col("doc_id").alias("id"), _first_line().alias("headline"), _after_first_line().alias("summary"), F.timestamp_seconds(F.lit(1700000000) + F.col("doc_id") * 600).alias("at"), F.array("source").alias("tickers"), F.array("source").alias("entities"), F.when(F.col("doc_id") % 7 == 0, F.to_date(F.timestamp_seconds(F.lit(1700000000) + F.col("doc_id") * 600))).alias("event_date"), F.sha2("text", 256).alias("hash"))


def n03_entities(spark, sf_dir):
    return news.resolved(_articles(spark, sf_dir), _registry(spark), F.to_timestamp(F.lit("2030-01-01 00:00:00")))


def j10_n04_pairs(spark, sf_dir):
    return news.blocked_pairs(_articles(spark, sf_dir), [F.get("tickers", F.lit(0)), F.col("hash")])


def _blocks():
    return [F.get("tickers", F.lit(0)), F.col("hash")]


def _related(spark, sf_dir, **options):
    return news.relationships(_articles(spark, sf_dir), _blocks(), **options)


def n05_relationships(spark, sf_dir):
    return _related(spark, sf_dir)


def n08_groups(spark, sf_dir):
    return news.duplicate_groups(_articles(spark, sf_dir), _blocks())


def x08_jaccard(spark, sf_dir):
    docs = base.read(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("w"))
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return docs.join(after, "doc_id").select("doc_id", F.round(C.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"))


def _model_rows(spark, sf_dir):
    w = features.window()
    bars = split_adjusted(base.bars(spark, sf_dir), base.actions(spark, sf_dir))
    label = targets.price_targets(bars.select("ticker", "trading_date", "split_adjusted_close"), base.calendar(spark, sf_dir)).select("ticker", "decision_date", "target_return_5d", "target_end_date_5d")
    plain = bars.select("ticker", "trading_date", F.col("split_adjusted_close").alias("close"), F.col("split_adjusted_volume").alias("volume"), F.col("split_adjusted_open").alias("open")).withColumns(features.momentum(w)).withColumns(features.gaps(w))
    # fits pass over these rows again and again
    return written(plain.withColumnRenamed("trading_date", "decision_date").join(label, ["ticker", "decision_date"]), "model_rows")


INPUTS = ["momentum_5d", "momentum_10d", "momentum_20d", "gap_open", "intraday_return"]


def m05_logistic(spark, sf_dir):
    rows = _model_rows(spark, sf_dir).where("target_return_5d is not null").withColumn("up", (F.col("target_return_5d") > 0).cast("double"))
    train, test = rows.where("target_end_date_5d < date '1999-01-01'"), rows.where("decision_date >= date '1999-01-01'")
    prepare = models.Preprocessor(INPUTS).fit(train)
    return metrics.classification(models.probability(models.logistic(prepare.transform(train), "up", 0.1), prepare.transform(test)), "up", "probability_1")


def _tree_rows(spark, sf_dir):
    """Training and test rows before and from 1999 on, prepared for trees."""
    rows = _model_rows(spark, sf_dir).where("target_return_5d is not null")
    train, test = rows.where("target_end_date_5d < date '1999-01-01'"), rows.where("decision_date >= date '1999-01-01'")
    prepare = models.Preprocessor(INPUTS, scale=False).fit(train)
    return prepare.transform(train), prepare.transform(test)


def m07_forest(spark, sf_dir):
    train, test = _tree_rows(spark, sf_dir)
    return metrics.regression_errors(models.forest(train, "target_return_5d").transform(test), "target_return_5d", "prediction")


def m07_boosted(spark, sf_dir):
    train, test = _tree_rows(spark, sf_dir)
    return metrics.regression_errors(models.boosted(train, "target_return_5d").transform(test), "target_return_5d", "prediction")


def m08_profiles(spark, sf_dir):
    """Three settings side by side on the same prepared rows; the frozen profiles take the same way."""
    train, test = (written(rows.select("features", "target_return_5d"), "tree_rows") for rows in _tree_rows(spark, sf_dir))
    fits = {"ridge": lambda train, label: models.ridge(train, label, 1.0), "shallow": lambda train, label: models.boosted(train, label, 3, 2, 0.1, 50), "deeper": lambda train, label: models.boosted(train, label, 3, 4, 0.1, 50)}
    return models.run_profiles(train, test, "target_return_5d", fits)


def m01_baseline(spark, sf_dir):
    rows = base.read(spark, sf_dir, "labels").where("quality is not null")
    return models.train_mean(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1"), "quality").groupBy(F.round("prediction", 6).alias("prediction")).agg(F.count(F.lit(1)).alias("rows"))


def s01_tumbling(spark, sf_dir):
    return late_data.run_once(late_data.tumbling(late_data.event_stream(spark, sf_dir)), "tm_tumbling", "complete")


def s02_sessions(spark, sf_dir):
    return late_data.run_once(late_data.sessions(late_data.event_stream(spark, sf_dir)), "tm_sessions", "complete")


def s03_first_seen(spark, sf_dir):
    stream = late_data.first_seen(late_data.event_stream(spark, sf_dir), ["user_id", "event_type"])
    return late_data.run_once(stream.select("user_id", "event_type"), "tm_first").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))


QUERIES = {
    "sc01_sql": sc01_sql,
    "sc04_filtered_scan": sc04_filtered_scan,
    "sc06_upsert": sc06_upsert,
    "sc07_replace_dates": sc07_replace_dates,
    "sc08_latest_date": sc08_latest_date,
    "sc11_replace_range": sc11_replace_range,
    "sc12_feature_range": sc12_feature_range,
    "sc17_records": sc17_records,
    "sc19_migrated": sc19_migrated,
    "sc15_sc21_integrity": sc15_sc21_integrity,
    "sc23_parse_bars": sc23_parse_bars,
    "sc25_parse_news": sc25_parse_news,
    "sc29_symbols": sc29_symbols,
    "q01_duplicates": q01_duplicates,
    "q02_violations": q02_violations,
    "w25_gaps": w25_gaps,
    "a11_diagnostics": a11_diagnostics,
    "a10_coverage": a10_coverage,
    "q06_outliers": q06_outliers,
    "a12_health": a12_health,
    "t04_extremes": t04_extremes,
    "t07_round_robin": t07_round_robin,
    "a13_counts": a13_counts,
    "a18_costs": a18_costs,
    "l03_quotes": l03_quotes,
    "x02_links": x02_links,
    "x03_ids": x03_ids,
    "x04_decision_time": x04_decision_time,
    "f16_registry": f16_registry,
    "n03_entities": n03_entities,
    "j10_n04_pairs": j10_n04_pairs,
    "n05_relationships": n05_relationships,
    "n08_groups": n08_groups,
    "x08_jaccard": x08_jaccard,
    "m05_logistic": m05_logistic,
    "m07_forest": m07_forest,
    "m07_boosted": m07_boosted,
    "m08_profiles": m08_profiles,
    "m01_baseline": m01_baseline,
    "s01_tumbling": s01_tumbling,
    "s02_sessions": s02_sessions,
    "s03_first_seen": s03_first_seen,
}

ORACLES = {
    "sc01_sql": "select o_orderstatus, count(*) as orders, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total from orders where o_totalprice > 1000.0 group by 1",
    "sc04_filtered_scan": "select o_orderkey, o_orderstatus from orders where o_orderstatus in ('F', 'P') and o_totalprice >= 100000.0",
    "sc06_upsert": base.sql("select ticker, trading_date, case when trading_date >= date '1999-01-01' then close * 2 else close end as close, case when trading_date >= date '1999-01-01' then timestamp '2024-02-01 00:00:00' else timestamp '2024-01-01 00:00:00' end as ingested_at from bars"),
    "sc07_replace_dates": base.sql("select ticker, effective_date, action_type, cast(case when effective_date >= date '1998-01-01' then 2 else 1 end as integer) as ingested_at from actions where effective_date < date '1998-01-01' or action_type = 'split'"),
    "sc08_latest_date": base.sql("select ticker, max(trading_date) as latest from bars group by 1"),
    "sc11_replace_range": base.sql("select ticker, count(*) as rows from bars where not (ticker in ('NATION_1', 'NATION_2') and trading_date between date '1996-01-01' and date '1996-12-31') or dayofweek(trading_date) = 1 group by 1"),
    "sc12_feature_range": base.sql("select ticker, trading_date as decision_date, close from bars where trading_date between date '1996-01-01' and date '1996-12-31' and ticker in ('NATION_1', 'NATION_7')"),
    "sc17_records": "select revision_id, ts as first_seen_at, sha256(cast(event_id as varchar)) as raw_hash from (select *, user_id || '-' || event_type as revision_id, row_number() over (partition by user_id, event_type order by ts, sha256(cast(event_id as varchar))) as n from events) where n = 1",
    "sc19_migrated": "select event_id, case when event_id % 3 = 0 then ts + interval 1 day else ts end as available_at, case when event_id % 3 = 0 then ts end as historical_proxy_at from events",
    "sc15_sc21_integrity": "select count(*) as records, count(distinct user_id) as articles, count(distinct user_id || '-' || event_type) as revisions, count(*) - count(distinct user_id || '-' || event_type) as duplicates, count(case when event_id % 5 = 0 then 1 end) as without_capture from events",
    "sc23_parse_bars": base.sql("select ticker, trading_date, round(close, 6) as close, 1.0 as split_factor, 0.0 as dividend_cash from bars"),
    "sc29_symbols": "select n_name as ticker, case n_name when 'NATION_1' then 'N.1' when 'NATION_2' then 'N.2' else n_name end as provider_symbol from nation",
    "q01_duplicates": "select l_orderkey, l_linenumber, count(*) as rows from lineitem group by 1, 2 having count(*) > 1",
    "q02_violations": base.sql("select ticker, trading_date from bars where dayofmonth(trading_date) in (7, 8) or high < greatest(open, close, low) or low > least(open, close, high) or least(open, high, low, close) <= 0"),
    "w25_gaps": base.sql("select s.ticker, session from (select ticker, min(trading_date) as a, max(trading_date) as b from bars group by 1) s join calendar on session between a and b left join bars x on x.ticker = s.ticker and x.trading_date = session where x.ticker is null"),
    "a11_diagnostics": base.sql("select ticker, count(*) as bars, min(trading_date) as first_date, max(trading_date) as last_date, count(case when high < low then 1 end) as inverted, count(case when volume <= 0 then 1 end) as without_volume from bars group by 1"),
    "a10_coverage": base.sql("select min(n) as least, median(n) as median, avg(n) as mean, max(n) as most from (select session, count(distinct ticker) as n from calendar left join bars on trading_date = session and volume > 30 group by 1)"),
    "t04_extremes": base.sql("select * from (select ticker, trading_date, close, 'high' as side from bars order by 3 desc, 1, 2 limit 25) union all select * from (select ticker, trading_date, close, 'low' as side from bars order by 3, 1, 2 limit 25)"),
    "t07_round_robin": "select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by doc_id) as n from documents) order by n, lang limit 50",
    "a13_counts": "select event_type, count(*) as n from events group by 1",
    "a18_costs": "select event_type, day, cast(sum(case when event_id % 10 > 0 then cast(value as decimal(18,2)) end) as double) as cost, count(case when event_id % 10 = 0 then 1 end) as unknown, grouping_id(event_type, day) as level from (select *, dayofmonth(ts) as day from events) group by cube (event_type, day)",
    "l03_quotes": "select doc_id, case when instr(text, q) = 0 then 'absent' when instr(substr(text, instr(text, q) + 1), q) > 0 then 'ambiguous' else 'resolved' end as status, case when instr(text, q) > 0 and instr(substr(text, instr(text, q) + 1), q) = 0 then instr(text, q) - 1 end as first from (select doc_id, text, substr(text, 5, 12) as q from documents)",
    "x03_ids": "select doc_id, sha256('news' || chr(0) || source || chr(0) || cast(doc_id as varchar)) as news_id from documents",
    "x04_decision_time": base.sql("select session, (cast(session as timestamp) + interval 20 hour + interval 15 minute + case when session >= date '1995-04-02' and session < date '1995-10-29' or session >= date '1996-04-07' and session < date '1996-10-27' or session >= date '1997-04-06' and session < date '1997-10-26' or session >= date '1998-04-05' and session < date '1998-10-25' or session >= date '1999-04-04' and session < date '1999-10-31' or session >= date '2000-04-02' and session < date '2000-10-29' or session >= date '2001-04-01' and session < date '2001-10-28' then interval 4 hour else interval 5 hour end) as cutoff, cast(year(session) * 100 + quarter(session) as integer) as quarter from calendar"),
    "j10_n04_pairs": "with r as (select doc_id, source as k, 1700000000 + doc_id * 600 as t from documents union all select doc_id, sha256(text), 1700000000 + doc_id * 600 from documents) select distinct a.doc_id as left_id, b.doc_id as right_id from r a join r b on a.k = b.k and a.doc_id < b.doc_id and abs(a.t - b.t) <= 172800",
    "m01_baseline": "select round((select avg(quality) from labels where doc_id % 2 = 0), 6) as prediction, count(*) as rows from labels where doc_id % 2 = 1",
    "s01_tumbling": "select date_trunc('day', ts) as start, event_type, count(*) as events, cast(sum(cast(value as decimal(18,2))) as double) as total from events group by 1, 2",
    "s03_first_seen": "select event_type, count(distinct user_id) as users from events group by 1",
}
