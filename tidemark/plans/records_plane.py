"""Stores, ingestion, joins, news snapshots and extraction checks over the driver's tables."""

from __future__ import annotations

import json
import uuid
from datetime import date

from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import allocation, attribution, extraction, metrics, news, quality
from tidemark.operators.asof import query_as_of
from tidemark.plans import base, pit_plane, store_plane
from tidemark.session import shared_dir
from tidemark.sources import ingestion, provider, store, tables
from tidemark.streaming import late_data

_BARS = "ticker string, trading_date date, close double"


def _root(spark, label):
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _closes(spark, sf_dir):
    return base.bars(spark, sf_dir).select("ticker", "trading_date", "close")


def sc05_ticker_rows(spark, sf_dir):
    """One ticker of a table partitioned by ticker, and of a table that isn't there."""
    root = _root(spark, "bars")
    tables.save(_closes(spark, sf_dir), root, ["ticker"])
    there = store.ticker_rows(spark, root, "NATION_3", _BARS)
    return there.unionByName(store.ticker_rows(spark, f"{root}-missing", "NATION_3", _BARS))


def sc09_replaced_events(spark, sf_dir):
    """Events deduplicated by id, replacing the table of the split actions that was there before."""
    actions = base.actions(spark, sf_dir).select(F.concat_ws("|", "ticker", "effective_date").alias("event_id"), "ticker", "effective_date", F.lit(1).alias("version"))
    root = _root(spark, "events")
    store.replace_table(actions, root)
    newer = actions.where("effective_date >= date '1998-01-01'").withColumn("version", F.lit(2))
    both = store.current_table(spark, root, actions.schema).unionByName(newer)
    store.replace_table(store.distinct_events(both, [F.desc("version")]), root)
    return store.current_table(spark, root, actions.schema)


def sc10_yearly_upsert(spark, sf_dir):
    rows = _closes(spark, sf_dir).withColumnRenamed("trading_date", "decision_date")
    root, scratch = _root(spark, "features"), _root(spark, "scratch")
    store.upsert_years(rows.where("year(decision_date) < 1999"), root, ["ticker", "decision_date"], scratch)
    store.upsert_years(rows.where("year(decision_date) in (1998, 1999)").withColumn("close", -F.col("close")), root, ["ticker", "decision_date"], scratch)
    return spark.read.schema("ticker string, decision_date date, close double, year int").parquet(root)


def _captures(spark, sf_dir):
    e = base.read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("provider"), F.concat(F.lit("payload "), F.col("user_id").cast("string")).alias("payload"))
    return e.select("provider", F.col("event_id").alias("capture_id"), F.sha2("payload", 256).alias("payload_hash"), "payload")


def sc16_raw_items(spark, sf_dir):
    found = _captures(spark, sf_dir)
    payloads = store.refuse_collisions(found.select("payload_hash", "payload").distinct())
    return store.raw_items(found.drop("payload"), payloads, "purchase").select("provider", "capture_id", "payload")


def _provider_records(spark, sf_dir):
    e = base.read(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("provider"), F.col("event_id").cast("string").alias("revision_id"), F.lit("1").alias("schema_version"), F.lit("1").alias("normalizer_version"), F.col("ts").alias("first_seen_at"), F.sha2(F.concat(F.lit("payload "), F.col("user_id").cast("string")), 256).alias("raw_hash"), F.col("user_id").alias("news_id"))


def sc18_replace_provider(spark, sf_dir):
    rows = _provider_records(spark, sf_dir)
    fresh = rows.where("provider = 'click' and cast(revision_id as bigint) % 2 = 0").withColumn("raw_hash", F.lit("new"))
    return store.replace_provider(rows, fresh, "click", "1", "1").select("provider", "revision_id", "raw_hash")


def sc20_lineage(spark, sf_dir):
    rows = _provider_records(spark, sf_dir).where("provider = 'error'")
    found = store.lineage(rows, _captures(spark, sf_dir))
    return found.groupBy("revision_id").agg(F.count(F.lit(1)).alias("captures"))


def sc21_raw_integrity(spark, sf_dir):
    found = _captures(spark, sf_dir)
    payloads = found.select("payload_hash", F.when(F.length("payload") % 5 == 0, F.lit("broken")).otherwise(F.col("payload")).alias("payload")).distinct()
    return store.raw_integrity(_provider_records(spark, sf_dir), found.where("capture_id % 3 > 0"), payloads)


def _clusters(spark, sf_dir):
    """Events as inputs, one cluster for each user; every eleventh user is missing, every thirteenth's first event is twice there."""
    e = base.read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id")
    found = e.where("user_id % 11 > 0").groupBy("user_id").agg(F.array_sort(F.collect_list("id")).alias("members"))
    again = found.where("user_id % 13 = 0").select("user_id", F.slice("members", 1, 1).alias("members"))
    return e.select("id"), found.unionByName(again), e.select((F.col("id") + F.when(F.col("id") % 100 == 0, 10**12).otherwise(0)).alias("id"))


def sc22_snapshot(spark, sf_dir):
    """A written snapshot, read again, and the faults of its partition into clusters."""
    inputs, clusters, links = _clusters(spark, sf_dir)
    tables_ = {"inputs": inputs, "entity_links": links, "clusters": clusters.select("members"), "pair_evidence": inputs.limit(0)}
    root = _root(spark, "snapshots")
    found = store.read_snapshot(spark, root, store.write_snapshot(tables_, root, {"cutoff": "2024-02-01"}))
    parsed = lambda name, schema: found[name].select(F.from_json("record_json", schema).alias("r")).select("r.*")
    return store.partition_faults(parsed("inputs", "id bigint"), parsed("clusters", "members array<bigint>"), parsed("entity_links", "id bigint"))


def sc24_diagnosed(spark, sf_dir):
    aliases = spark.createDataFrame([("NATION_1", "N.1")], "ticker string, provider_symbol string")
    symbols = tables.internal_symbols(base.read(spark, sf_dir, "nation").select(F.col("n_name").alias("ticker")).unionByName(spark.createDataFrame([("GONE",)], "ticker string")), aliases)
    return ingestion.diagnosed(symbols, base.bars(spark, sf_dir).where("trading_date >= date '2000-01-01'"))


REQUESTED, END = date(1998, 1, 1), date(1999, 12, 31)


def _refreshed(spark, sf_dir):
    bars = _closes(spark, sf_dir).withColumn("provider", F.lit("p"))
    stored = bars.where("trading_date <= date '1999-03-31' and not (ticker = 'NATION_2' and trading_date > date '1997-06-30')").withColumn("ingested_at", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    provided = bars.where("dayofmonth(trading_date) not in (3, 30)").withColumn("close", F.col("close") + 1).withColumn("ingested_at", F.to_timestamp(F.lit("2024-02-01 00:00:00")))
    return ingestion.refresh(stored, provided, base.calendar(spark, sf_dir), REQUESTED, END, 10)


def sc27_refreshed_bars(spark, sf_dir):
    return _refreshed(spark, sf_dir)[0].select("ticker", "trading_date", "close")


def sc27_refresh_summary(spark, sf_dir):
    return _refreshed(spark, sf_dir)[1]


def _news_items(spark, sf_dir):
    return store_plane._news_lines(spark, sf_dir).select(F.col("value").alias("payload"))


def sc28_ingested_news(spark, sf_dir):
    """Summary of a second intake that repeats two thirds of the first."""
    items = _news_items(spark, sf_dir).withColumn("id", F.get_json_object("payload", "$.id").cast("bigint"))
    at = F.to_timestamp(F.lit("2023-11-20 00:00:00"))
    records = ingestion.rebuild_news(items.limit(0).select("payload"), "finn", at)
    captures = items.limit(0).select("payload", F.lit("").alias("payload_hash"), at.alias("captured_at"))
    captures, records, _ = ingestion.ingest_news(items.where("id % 3 < 2").select("payload"), captures, records, "finn", at)
    return ingestion.ingest_news(items.select("payload"), captures, records, "finn", at + F.expr("interval 1 day"))[2]


def sc28_rebuilt_news(spark, sf_dir):
    at = F.to_timestamp(F.lit("2023-11-20 00:00:00"))
    return ingestion.rebuild_news(_news_items(spark, sf_dir), "finn", at).select("news_id", F.array_join("direct_tickers", ",").alias("direct_tickers"), "available_at")


def sc30_csv(spark, sf_dir):
    path = _root(spark, "summary")
    store.save_csv(base.read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path)
    return spark.read.schema("n_nationkey int, n_name string").option("header", True).csv(path)


def sc31_audit(spark, sf_dir):
    path = _root(spark, "audit")
    for kind in ("click", "view"):
        tables.append_audit(base.read(spark, sf_dir, "events").where(F.col("event_type") == kind).select("event_id", "event_type"), path)
    return store.audit_rows(spark, path, "event_id bigint, event_type string").groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))


def sc32_universe(spark, sf_dir):
    path = f"{_root(spark, 'config')}.json"
    store.write_text(spark, path, json.dumps({"benchmark": "spy", "tickers": ["nation_1 ", "NATION_2"]}))
    config = store.load_config(spark, path)
    return store.universe(spark, config["benchmark"], config["tickers"])


def sc33_budget(spark, sf_dir):
    e = base.read(spark, sf_dir, "events")
    ledger = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("budget"), F.col("value").cast("decimal(18,2)").alias("reserved"), F.lit(None).cast("decimal(18,2)").alias("settled"))
    entries = e.where("event_id % 4 = 0").select(F.col("event_id").alias("id"), F.floor("value").cast("decimal(18,2)").alias("amount"))
    after = store.settled(ledger, entries)
    return after.groupBy("budget").agg(F.sum(F.coalesce("settled", "reserved")).cast("double").alias("in_use"), F.count("settled").alias("settled"))


def j03_audit_columns(spark, sf_dir):
    """Adjusted closes with the raw close and volume of the same key."""
    adjusted = pit_plane._latest(spark, sf_dir).select("ticker", "trading_date", "split_adjusted_close")
    raw = base.bars(spark, sf_dir).select("ticker", "trading_date", F.col("close").alias("raw_close"), F.col("volume").alias("raw_volume"))
    return adjusted.join(raw, ["ticker", "trading_date"], "left").where("split_adjusted_close <> raw_close")


def j11_band_pairs(spark, sf_dir):
    """All pairs of articles at most two hours apart: slots of the band instead of a cross join."""
    return news.blocked_pairs(store_plane._articles(spark, sf_dir), [F.lit("all")], max_hours=2)


def _executions(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "A", "filled").when(F.col("l_returnflag") == "N", "partially_filled").otherwise("unfilled")
    return base.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), kind.alias("status"), F.to_date("l_shipdate").alias("session"), F.col("l_extendedprice").cast("decimal(18,2)").alias("notional"))


def j14_a16_pending(spark, sf_dir):
    orders = base.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"))
    found = allocation.execution_report(_executions(spark, sf_dir), orders)
    return found.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


def j15_fill_notional(spark, sf_dir):
    """Traded notional of the sessions that have a snapshot, and how many fill sessions have none."""
    fills = _executions(spark, sf_dir)
    nav = base.calendar(spark, sf_dir).where("seq % 2 = 0").select("session", F.lit(1000000.0).alias("nav"))
    missing = allocation.unmatched_fills(fills, nav).agg(F.count(F.lit(1)).alias("unmatched_sessions"))
    traded = fills.groupBy("session").agg(F.sum("notional").alias("traded")).join(nav, "session")
    return traded.agg(F.count(F.lit(1)).alias("sessions"), F.sum("traded").cast("double").alias("traded")).crossJoin(F.broadcast(missing))  # one row each


def j17_alignment(spark, sf_dir):
    """Agreement of two label sets, by dimension, after a check that neither repeats a key."""
    labels = base.read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    system = labels.select("doc_id", F.when(F.col("doc_id") % 10 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("q"), F.col("toxic").alias("t")).where("doc_id % 17 > 0")
    joined = labels.join(system, "doc_id", "left")
    rows = F.array(F.struct(F.lit("quality").alias("dimension"), (F.col("quality") == F.col("q")).alias("same")), F.struct(F.lit("toxic").alias("dimension"), (F.col("toxic") == F.col("t")).alias("same")))
    return joined.select(F.inline(rows)).groupBy("dimension").agg(F.count_if("same").alias("agreed"), F.count_if(~F.col("same")).alias("differed"), F.count_if(F.col("same").isNull()).alias("missing"))


def n06_editorial_rules(spark, sf_dir):
    return store_plane._related(spark, sf_dir, second=True)


def n09_snapshot_clusters(spark, sf_dir):
    """Groups of exact duplicates, and lone articles, as clusters with content ids."""
    shared_dir(spark)
    grouped = news.groups(store_plane._articles(spark, sf_dir), store_plane._related(spark, sf_dir, exact=True), ["exact_duplicate"])
    return news.cluster_ids(grouped, "groups-1").select("cluster_id", "representative", F.size("members").alias("members"))


def n10_evaluation(spark, sf_dir):
    """Predicted exact duplicates against equal texts."""
    pairs = store_plane._related(spark, sf_dir, agreeing=("hash",), exact=True)
    return metrics.confusion(pairs, F.col("same_hash"), F.col("relationship") == "exact_duplicate").select("fp", "fn")


def n11_review_sample(spark, sf_dir):
    """100 candidate pairs for review: strata by source in turn, by hash within a stratum."""
    pairs = store_plane.j10_n04_pairs(spark, sf_dir).where("left_id % 7 = 0")
    source = base.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("left_id"), "source")
    return quality.round_robin(pairs.join(source, "left_id"), "source", [F.sha2(F.concat_ws("|", "left_id", "right_id"), 256)], 100)


def l01_requests(spark, sf_dir):
    cutoff = F.to_timestamp(F.lit("2024-01-20 00:00:00"))
    rows = [("click", "s1", date(2000, 1, 1), None, "2001-01-01"), ("click", "s2", date(2024, 1, 10), None, "2001-01-01"), ("view", "s3", date(2000, 1, 1), date(2024, 1, 5), "2001-01-01"), ("error", "s4", date(2000, 1, 1), None, "2024-02-01")]
    registry = spark.createDataFrame(rows, "ticker string, security_id string, effective_from date, effective_to date, known string").withColumn("known_at", F.to_timestamp("known"))
    found = extraction.requests(query_as_of(pit_plane._revisions(spark, sf_dir), cutoff), registry, cutoff)
    return found.select("revision_id", "fact_date", F.array_join("securities", ",").alias("securities"))


def l02_event_faults(spark, sf_dir):
    """Lexical faults of events whose quotes are built from the events table."""
    e = base.read(spark, sf_dir, "events")
    words = F.array(*[F.lit(x) for x in ("deal announced", "deal may close", "deal not completed", "rumour of a deal", "deal closed")])
    rows = e.select("event_id", F.get(words, F.pmod("event_id", F.lit(5)).cast("int")).alias("quote"), F.when(F.col("event_id") % 2 == 0, "confirmed").otherwise("reported").alias("state"), F.when(F.col("event_id") % 3 == 0, "completed").when(F.col("event_id") % 3 == 1, "announced").otherwise("unknown").alias("stage"), (F.col("event_id") % 7 == 0).alias("negated"))
    faults = extraction.event_faults(F.col("state"), F.col("stage"), F.col("quote"), F.col("negated"))
    return rows.select("event_id", F.array_join(F.array_sort(faults), ",").alias("faults")).where("faults <> ''")


def l02_contradictions(spark, sf_dir):
    lines = base.read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("role"), F.col("l_linestatus").alias("unit"), F.col("l_quantity").alias("value"))
    return extraction.contradictory_amounts(lines, ["l_orderkey"])


def l04_number_faults(spark, sf_dir):
    p = base.read(spark, sf_dir, "part")
    text = F.format_number("p_retailprice", 2)
    value = F.regexp_replace(text, ",", "").cast("decimal(38,18)")
    quote = F.concat(F.lit("sold for "), F.when(F.col("p_partkey") % 5 == 0, F.lit("much")).otherwise(text), F.lit(" usd a piece"))
    faults = extraction.number_faults(F.when(F.col("p_partkey") % 7 == 0, "n/a").otherwise(text), F.when(F.col("p_partkey") % 3 == 0, value + 1).otherwise(value), quote, F.when(F.col("p_partkey") % 11 == 0, "eur").otherwise("usd"), F.lit("one"), F.lit(None).cast("string"))
    return p.select("p_partkey", F.array_join(F.array_sort(faults), ",").alias("faults")).where("faults <> ''")


def l05_attribution(spark, sf_dir):
    """Attribution faults of sentences about pairs of nations."""
    n = base.read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    peer = n.select((F.col("n_nationkey") - 1).alias("n_nationkey"), F.col("name").alias("peer"))
    kind = F.pmod("n_nationkey", F.lit(5)).cast("int")
    verbs = F.array(*[F.lit(x) for x in (" today announced that it has acquired ", " sued ", " may partner with ", " competes with ", " was seen near ")])
    pick = lambda *values: F.get(F.array(*[F.lit(v) for v in values]), kind)
    rows = n.join(peer, "n_nationkey").select(
        "n_nationkey", "name", "peer", F.concat("name", F.get(verbs, kind), "peer", F.lit(".")).alias("quote"),
        pick("direct_participant", "direct_participant", "direct_participant", "supported_indirect", "contextual_mention").alias("attribution"),
        pick("buyer", "legal_subject", "partner", "unknown", "buyer").alias("role"), pick("transaction", "litigation", "partnership", "competition", "unknown").alias("relation"),
        pick("ma", "litigation", "other", "other", "other").alias("event_type"), F.lit("reported").alias("state"),
    )
    return attribution.attribution_faults(rows).select("n_nationkey", F.array_join("faults", ",").alias("faults"))


def l06_replay(spark, sf_dir):
    e = base.read(spark, sf_dir, "events").select("event_id", "event_type", "props")
    replayed = e.where("event_id % 10 > 0").withColumn("props", F.when(F.col("event_id") % 9 == 0, F.lit("{}")).otherwise(F.col("props")))
    return extraction.replay_faults(e, replayed, "event_id", ["event_type", "props"])


def l08_reservations(spark, sf_dir):
    docs = base.read(spark, sf_dir, "documents").where("text is not null")
    bound = extraction.reservation_bound(F.octet_length("text"), F.lit(500), F.lit(3.0), F.lit(15.0))
    return docs.select("doc_id", F.round(bound, 9).alias("bound"))


def l10_sidecars(spark, sf_dir):
    rows = base.read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("created_at")).withColumn("expires_at", F.col("created_at") + F.expr("interval 3 days"))
    return extraction.alive(rows, F.to_timestamp(F.lit("2024-01-10 00:00:00"))).select("event_id")


def l11_cache(spark, sf_dir):
    docs = base.read(spark, sf_dir, "documents").where("text is not null").select("doc_id", "lang", "text")
    key = F.sha2(F.concat_ws("\u0000", "lang", "text"), 256)
    cache = docs.where("doc_id % 3 = 0").select(key.alias("content_hash"), "doc_id").groupBy("content_hash").agg(F.min("doc_id").alias("response"))
    return extraction.cached(docs, cache, ["lang", "text"]).select("doc_id", "response")


def l12_routes(spark, sf_dir):
    routes = spark.createDataFrame([("default", "small"), ("click", "large"), ("EUROPE.view", "medium")], "route string, model string")
    tasks = base.read(spark, sf_dir, "events").select(F.col("event_type").alias("task")).distinct().crossJoin(F.broadcast(base.read(spark, sf_dir, "region").select(F.col("r_name").alias("agent"))))  # five regions
    return extraction.routed(tasks, routes)


def s05_stream_static(spark, sf_dir):
    users = base.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    stream = late_data.with_registry(late_data.event_stream(spark, sf_dir), users, "user_id").select("event_id", "segment")
    return late_data.run_once(stream, "tm_static")


def s02_sliding(spark, sf_dir):
    return late_data.run_once(late_data.sliding(late_data.event_stream(spark, sf_dir)), "tm_sliding", "complete")


def s06_batch_upserts(spark, sf_dir):
    path = _root(spark, "upserts")
    late_data.upsert_batches(late_data.event_stream(spark, sf_dir), path, ["user_id", "event_type"]).start().awaitTermination()
    return late_data.newest_version(spark, path).select("user_id", "event_type", "ts")


def s07_running_state(spark, sf_dir):
    """Count and last time of each user, kept as state by a custom operator."""
    return late_data.run_once(late_data.running(late_data.event_stream(spark, sf_dir)), "tm_running", "update")


def e01_data_source(spark, sf_dir):
    """Bars through the Python data source, a partition for each ticker's file."""
    folder = _root(spark, "provider")
    names = ["NATION_3", "NATION_7"]
    for name in names:
        bars = base.bars(spark, sf_dir).where(F.col("ticker") == name).orderBy("trading_date").limit(50).collect()
        store.write_text(spark, f"{folder}/{name}.json", json.dumps([{"date": str(r.trading_date), "close": r.close, "volume": r.volume} for r in bars]))
    provider.register(spark)
    source = spark.read.format("tidemark_bars").option("folder", folder.removeprefix("file:")).option("tickers", ",".join(names))
    return source.load().select("ticker", F.to_date("trading_date").alias("trading_date"), F.round("close", 6).alias("close"))


def e01_table_function(spark, sf_dir):
    provider.register(spark)
    base.read(spark, sf_dir, "region").createOrReplaceTempView("tm_region")
    return spark.sql("select r_regionkey, word, first, last from tm_region, lateral word_spans(r_name)")


def x07_repeated_keys(spark, sf_dir):
    e = base.read(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 5 == 0, F.lit('{"a": 1, "a": 2}')).when(F.col("event_id") % 5 == 1, F.lit("{")).otherwise(F.lit('{"a": {"a": 1}}'))
    return e.select("event_id", C.repeats_a_key(text).alias("repeated"))


def x08_word_pairs(spark, sf_dir):
    """Jaccard of word pairs without figures, of neighbouring documents."""
    docs = base.read(spark, sf_dir, "documents").where("text is not null").select("doc_id", C.word_pairs(C.words(F.col("text"))).alias("p"))
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("p").alias("q"))
    return docs.join(after, "doc_id").select("doc_id", F.round(C.jaccard(F.col("p"), F.col("q")), 6).alias("jaccard"))


QUERIES = {
    f.__name__: f
    for f in (
        sc05_ticker_rows, sc09_replaced_events, sc10_yearly_upsert, sc16_raw_items, sc18_replace_provider, sc20_lineage, sc21_raw_integrity, sc22_snapshot, sc24_diagnosed,
        sc27_refreshed_bars, sc27_refresh_summary, sc28_ingested_news, sc28_rebuilt_news, sc30_csv, sc31_audit, sc32_universe, sc33_budget,
        j03_audit_columns, j11_band_pairs, j14_a16_pending, j15_fill_notional, j17_alignment, n06_editorial_rules, n09_snapshot_clusters, n10_evaluation, n11_review_sample,
        l01_requests, l02_event_faults, l02_contradictions, l04_number_faults, l05_attribution, l06_replay, l08_reservations, l10_sidecars, l11_cache, l12_routes,
        s02_sliding, s05_stream_static, s06_batch_upserts, s07_running_state, e01_data_source, e01_table_function, x07_repeated_keys, x08_word_pairs,
    )
}

_STARTS = "(select ticker, case when ticker = 'NATION_2' then date '1998-01-01' else greatest(date '1998-01-01', latest - 10) end as start from (select ticker, max(trading_date) as latest from bars where trading_date <= date '1999-03-31' group by 1))"
_FETCHED = f"starts as {_STARTS}, fetched as (select b.* from bars b join starts using (ticker) where trading_date between start and date '1999-12-31' and dayofmonth(trading_date) not in (3, 30)), stored as (select * from bars where trading_date <= date '1999-03-31' and not (ticker = 'NATION_2' and trading_date > date '1997-06-30'))"
_PROVIDER = "select event_type as provider, cast(event_id as varchar) as revision_id, sha256('payload ' || user_id) as raw_hash, event_id, user_id from events"
_KIND = "case l_returnflag when 'A' then 'filled' when 'N' then 'partially_filled' else 'unfilled' end"
_QUOTES = "select event_id, ['deal announced', 'deal may close', 'deal not completed', 'rumour of a deal', 'deal closed'][event_id % 5 + 1] as q, event_id % 2 = 0 as confirmed, event_id % 3 as s, event_id % 7 = 0 as negated from events"

ORACLES = {
    "sc05_ticker_rows": base.sql("select ticker, trading_date, close from bars where ticker = 'NATION_3'"),
    "sc09_replaced_events": base.sql("select ticker || '|' || effective_date as event_id, ticker, effective_date, cast(case when effective_date >= date '1998-01-01' then 2 else 1 end as integer) as version from actions"),
    "sc10_yearly_upsert": base.sql("select ticker, trading_date as decision_date, case when year(trading_date) >= 1998 then -close else close end as close, cast(year(trading_date) as integer) as year from bars where year(trading_date) <= 1999"),
    "sc16_raw_items": "select event_type as provider, event_id as capture_id, 'payload ' || user_id as payload from events where event_type = 'purchase'",
    "sc18_replace_provider": f"select provider, revision_id, case when provider = 'click' then 'new' else raw_hash end as raw_hash from ({_PROVIDER}) where provider <> 'click' or event_id % 2 = 0",
    "sc20_lineage": f"select revision_id, (select count(*) from events e where e.user_id = p.user_id) as captures from ({_PROVIDER}) p where provider = 'error'",
    "sc21_raw_integrity": "select (select count(*) from events where event_id % 3 > 0) as raw_captures, (select count(distinct user_id) from events) as raw_payloads, (select count(distinct user_id) from events where length('payload ' || user_id) % 5 = 0) as bad_raw_hashes, count(*) as normalized_records, count(distinct user_id) as logical_articles, 0::bigint as duplicate_records, (select count(*) from events where user_id not in (select user_id from events where event_id % 3 > 0)) as missing_lineage from events",
    "sc22_snapshot": "select count(*) as inputs, count(case when user_id % 11 > 0 then 1 end) + (select count(distinct user_id) from events where user_id % 13 = 0 and user_id % 11 > 0) as members, count(case when user_id % 11 = 0 then 1 end) as in_none, (select count(distinct user_id) from events where user_id % 13 = 0 and user_id % 11 > 0) as in_several, 0::bigint as unknown_members, count(case when event_id % 100 = 0 then 1 end) as unknown_links from events",
    "sc24_diagnosed": base.sql("select t.ticker, case t.ticker when 'NATION_1' then 'N.1' else t.ticker end as provider_symbol, min(trading_date) as first_date, max(trading_date) as last_date, count(trading_date) as bars, case when count(trading_date) = 0 then 'no data' end as error from (select n_name as ticker from nation union all select 'GONE') t left join (select * from bars where trading_date >= date '2000-01-01') b on b.ticker = t.ticker group by 1, 2"),
    "sc27_refreshed_bars": base.sql("select coalesce(f.ticker, s.ticker) as ticker, coalesce(f.trading_date, s.trading_date) as trading_date, coalesce(f.close + 1, s.close) as close from fetched f full join stored s on s.ticker = f.ticker and s.trading_date = f.trading_date", _FETCHED),
    "sc27_refresh_summary": base.sql("select s.ticker, start, (select count(*) from fetched f where f.ticker = s.ticker) as downloaded, (select count(*) from stored b where b.ticker = s.ticker and b.trading_date between start and date '1999-12-31' and dayofmonth(b.trading_date) in (3, 30)) as missing_refreshed, (select count(*) from calendar where session between start and date '1999-12-31') - (select count(*) from fetched f where f.ticker = s.ticker) as gaps from starts s", _FETCHED),
    "sc28_ingested_news": "select count(*) as fetched_items, count(case when doc_id % 3 = 2 then 1 end) as new_raw_captures, count(*) as normalized_candidates, count(case when doc_id % 3 = 2 then 1 end) as new_normalized_revisions from documents",
    "sc30_csv": "select n_nationkey, n_name from nation",
    "sc31_audit": "select event_type, count(*) as rows from events where event_type in ('click', 'view') group by 1",
    "sc32_universe": "select * from (values ('NATION_1', false), ('NATION_2', false), ('SPY', true)) t(ticker, benchmark)",
    "sc33_budget": "select event_type as budget, cast(sum(case when event_id % 4 = 0 then cast(floor(value) as decimal(18,2)) else cast(value as decimal(18,2)) end) as double) as in_use, count(case when event_id % 4 = 0 then 1 end) as settled from events group by 1",
    "j03_audit_columns": base.sql("select ticker, trading_date, close / factor as split_adjusted_close, close as raw_close, volume as raw_volume from adjusted where close / factor <> close", pit_plane._LATEST),
    "j11_band_pairs": "select a.doc_id as left_id, b.doc_id as right_id from documents a join documents b on b.doc_id > a.doc_id and (b.doc_id - a.doc_id) * 600 <= 7200 where a.text is not null and b.text is not null",
    "j14_a16_pending": f"select count(*) as records, count(case when s = 'filled' then 1 end) as filled_orders, count(case when s = 'partially_filled' then 1 end) as partially_filled_orders, count(case when s = 'unfilled' then 1 end) as unfilled_orders, round(avg(cast(s = 'filled' as integer)), 9) as filled_rate, round(avg(cast(s = 'partially_filled' as integer)), 9) as partially_filled_rate, round(avg(cast(s = 'unfilled' as integer)), 9) as unfilled_rate, (select count(*) from orders where o_orderkey not in (select l_orderkey from lineitem)) as pending_orders from (select {_KIND} as s from lineitem)",
    "j15_fill_notional": base.sql("select count(distinct session) as sessions, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as traded, (select count(*) from calendar where seq % 2 = 1) as unmatched_sessions from lineitem join calendar on session = cast(l_shipdate as date) where seq % 2 = 0"),
    "j17_alignment": "with l as (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by 1) select 'quality' as dimension, count(case when doc_id % 17 > 0 and doc_id % 10 > 0 and quality is not null then 1 end) as agreed, count(case when doc_id % 17 > 0 and doc_id % 10 = 0 and quality is not null then 1 end) as differed, count(case when doc_id % 17 = 0 or quality is null then 1 end) as missing from l union all select 'toxic', count(case when doc_id % 17 > 0 and toxic is not null then 1 end), 0, count(case when doc_id % 17 = 0 or toxic is null then 1 end) from l",
    "n11_review_sample": f"select left_id, right_id, source from (select left_id, right_id, d.source, row_number() over (partition by d.source order by sha256(left_id || '|' || right_id)) as n from ({store_plane.ORACLES['j10_n04_pairs'].replace('from documents', 'from documents where text is not null')}) join documents d on d.doc_id = left_id where left_id % 7 = 0) order by n, source limit 100",
    "l01_requests": "select event_id as revision_id, cast(ts as date) as fact_date, concat_ws(',', case when event_type = 'click' then 's1' when event_type = 'view' and cast(ts as date) < date '2024-01-05' then 's3' end, case when event_type = 'click' and cast(ts as date) >= date '2024-01-10' then 's2' end) as securities from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events where ts <= timestamp '2024-01-20 00:00:00') where n = 1",
    "l02_event_faults": f"select event_id, array_to_string(list_sort(list_filter([case when s = 1 and not regexp_matches(q, '\\bannounced\\b') then 'announced_literal_missing' end, case when s = 0 and not regexp_matches(q, '\\b(completed|closed|finalized)\\b') then 'completion_literal_missing' end, case when regexp_matches(q, '\\bnot\\b') and not negated then 'negation_token_present_flag_false' end, case when confirmed and regexp_matches(q, '\\b(rumour|may)\\b') then 'rumor_promoted' end], lambda x: x is not null)), ',') as faults from ({_QUOTES}) where faults <> ''",
    "l02_contradictions": 'select l_orderkey, l_returnflag as role, l_linestatus as unit, count(distinct l_quantity) as "values" from lineitem group by 1, 2, 3 having count(distinct l_quantity) > 1',
    "l04_number_faults": "select p_partkey, array_to_string(list_sort(list_filter([case when k % 7 = 0 then 'number_lexeme_unparseable' end, case when k % 7 <> 0 and k % 3 = 0 then 'number_value_nonfinite_or_transformed' end, case when k % 7 = 0 or k % 5 = 0 then 'number_absent_from_context' end, case when k % 11 = 0 then 'unit_absent_from_context' end], lambda x: x is not null)), ',') as faults from (select p_partkey, p_partkey as k from part) where faults <> ''",
    "l05_attribution": "select n_nationkey, case n_nationkey % 5 when 2 then 'attribution_state_conflict,relation_not_stated' when 4 then 'contextual_participation_forbidden' else '' end as faults from nation where n_nationkey < (select max(n_nationkey) from nation)",
    "l06_replay": "select event_id, case when event_id % 10 = 0 then 'not_replayed' else 'fingerprint_mismatch' end as fault from events where event_id % 10 = 0 or (event_id % 9 = 0 and props <> '{}')",
    "l08_reservations": "select doc_id, round((octet_length(encode(text)) * 3.0 + 500 * 15.0) / 1000000, 9) as bound from documents where text is not null",
    "l10_sidecars": "select event_id from events where ts <= timestamp '2024-01-10 00:00:00' and ts + interval 3 day > timestamp '2024-01-10 00:00:00'",
    "l11_cache": "with c as (select lang, text, min(doc_id) as response from documents where doc_id % 3 = 0 and text is not null group by 1, 2) select doc_id, response from documents d left join c on c.text = d.text and coalesce(c.lang, '') = coalesce(d.lang, '') where d.text is not null",
    "l12_routes": "select r_name as agent, event_type as task, case when event_type = 'click' then 'large' when r_name = 'EUROPE' and event_type = 'view' then 'medium' else 'small' end as model from region cross join (select distinct event_type from events)",
    "s02_sliding": "select start, count(*) as events from (select unnest([date_trunc('day', ts) - interval 1 day, date_trunc('day', ts)]) as start from events) group by 1",
    "s05_stream_static": "select event_id, c_mktsegment as segment from events left join customer on c_custkey = user_id",
    "s06_batch_upserts": "select user_id, event_type, max(ts) as ts from events group by 1, 2",
    "s07_running_state": "select user_id, count(*) as events, max(ts) as last_at from events group by 1",
    "e01_data_source": base.sql("select ticker, trading_date, round(close, 6) as close from (select *, row_number() over (partition by ticker order by trading_date) as n from bars where ticker in ('NATION_3', 'NATION_7')) where n <= 50"),
    "e01_table_function": "select r_regionkey, w as word, cast(instr(r_name, w) - 1 as integer) as first, cast(instr(r_name, w) - 1 + length(w) as integer) as last from (select r_regionkey, r_name, unnest(string_split(r_name, ' ')) as w from region)",
    "x07_repeated_keys": "select event_id, case event_id % 5 when 0 then true when 1 then null else false end as repeated from events",
}
