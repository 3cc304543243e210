"""Incremental intake: refreshed ranges with overlap, reconciliation, and news from raw captures."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.asof import extract_actions, split_adjusted
from tidemark.sources import tables


def refresh_starts(stored: DataFrame, tickers: DataFrame, requested: date, overlap_days: int = 5, full: bool = False) -> DataFrame:
    """(ticker, start): where each ticker's refresh begins, the overlap before its latest bar or as requested."""
    if overlap_days < 0:
        raise ValueError("the overlap must not be negative")
    latest = stored.groupBy("ticker").agg(F.max("trading_date").alias("latest"))
    begin = F.coalesce(F.greatest(F.lit(requested), F.date_sub("latest", overlap_days)), F.lit(requested))
    return tickers.select("ticker").distinct().join(latest, "ticker", "left").select("ticker", (F.lit(requested) if full else begin).alias("start"))


def refresh(stored: DataFrame, provided: DataFrame, calendar: DataFrame, requested: date, end: date, overlap_days: int = 5, full: bool = False) -> tuple[DataFrame, DataFrame]:
    """Bars after a refresh, and a summary of each ticker.

    stored and provided are bars (ticker, trading_date, provider, ingested_at, ...); what the provider
    has from a ticker's start to end is upserted. Stored dates of the range that it no longer has stay
    and are counted, as are sessions without a bar.
    """
    if requested > end:
        raise ValueError("a range must not end before it starts")
    starts = refresh_starts(stored, stored.select("ticker").unionByName(provided.select("ticker")), requested, overlap_days, full)
    inside = F.col("trading_date").between(F.col("start"), F.lit(end))
    fetched = provided.join(starts, "ticker").where(inside)
    there = stored.join(starts, "ticker").where(inside).select("ticker", "trading_date").distinct()
    came = fetched.select("ticker", "trading_date").distinct()
    gone = there.join(came, ["ticker", "trading_date"], "left_anti").groupBy("ticker").agg(F.count(F.lit(1)).alias("missing_refreshed"))
    due = calendar.where(F.col("session").between(F.lit(requested), F.lit(end))).select(F.col("session").alias("trading_date"))
    counts = fetched.groupBy("ticker").agg(F.count(F.lit(1)).alias("downloaded"), F.count_distinct("trading_date").alias("days"))
    # sessions from each ticker's start on: a running count from the end, looked up by equality after a sort
    rank = due.select("trading_date", F.lit(1).alias("one"))
    sessions = starts.select("ticker", F.explode(F.sequence(F.col("start"), F.lit(end))).alias("trading_date")).join(rank, "trading_date").groupBy("ticker").agg(F.count(F.lit(1)).alias("sessions"))
    summary = starts.join(counts, "ticker", "left").join(gone, "ticker", "left").join(sessions, "ticker", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    summary = summary.select("ticker", "start", n("downloaded").alias("downloaded"), n("missing_refreshed").alias("missing_refreshed"), (n("sessions") - n("days")).alias("gaps"))
    return tables.upsert(stored, fetched.drop("start"), tables.BAR_KEY), summary


def rebuilt(bars: DataFrame, actions: DataFrame, refreshed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Actions and latest-basis series after a refresh: actions of the refreshed (ticker, trading_date) come from the bars."""
    fresh = extract_actions(bars.join(refreshed.select("ticker", "trading_date").distinct(), ["ticker", "trading_date"], "left_semi"))
    kept = actions.join(refreshed.select("ticker", F.col("trading_date").alias("effective_date")).distinct(), ["ticker", "effective_date"], "left_anti")
    both = kept.select(*fresh.columns).unionByName(fresh)
    return both, split_adjusted(bars, both)


def ingest_news(items: DataFrame, captures: DataFrame, records: DataFrame, provider: str, captured_at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """captures and records after new raw items (payload) of a provider, and a one-row summary.

    A payload that was captured before adds nothing; records stay idempotent by revision.
    """
    new = tables.raw_captures(items.withColumn("captured_at", captured_at), captures)
    parsed = _normalized(items.select(F.col("payload").alias("value"), F.sha2(F.col("payload").cast("binary"), 256).alias("raw_hash")), provider, captured_at)
    inserted = parsed.select("revision_id").distinct().join(records.select("revision_id"), "revision_id", "left_anti")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    summary = count(items, "fetched_items").crossJoin(F.broadcast(count(new, "new_raw_captures"))).crossJoin(F.broadcast(count(parsed, "normalized_candidates"))).crossJoin(F.broadcast(count(inserted, "new_normalized_revisions")))  # one row each
    return captures.unionByName(new.select(*captures.columns)), tables.earliest_records(records, parsed.select(*records.columns)), summary


def _normalized(payloads: DataFrame, provider: str, captured_at: Column) -> DataFrame:
    """Revisions of raw payloads (value, raw_hash)."""
    hashes = payloads.select("raw_hash", F.from_json("value", tables.NEWS_JSON).alias("r")).select("raw_hash", F.col("r.id").alias("id")).where("id is not null")
    parsed = tables.parse_news(payloads, provider, captured_at)
    ids = hashes.select("raw_hash", F.sha2(F.concat_ws("\u0000", F.lit("news"), F.lit(provider), F.col("id").cast("string")), 256).alias("news_id")).distinct()
    versions = {"schema_version": F.lit("1"), "normalizer_version": F.lit("1"), "ingested_at": captured_at}
    return parsed.join(ids, "news_id").withColumns(versions)


def rebuild_news(payloads: DataFrame, provider: str, captured_at: Column) -> DataFrame:
    """All revisions anew from the raw payloads (payload)."""
    raw = payloads.select(F.col("payload").alias("value"), F.sha2(F.col("payload").cast("binary"), 256).alias("raw_hash"))
    return _normalized(raw, provider, captured_at)


def diagnosed(symbols: DataFrame, bars: DataFrame) -> DataFrame:
    """(ticker, provider_symbol, first_date, last_date, bars, error): what a provider has of each symbol; nothing is kept."""
    found = bars.groupBy("ticker").agg(F.min("trading_date").alias("first_date"), F.max("trading_date").alias("last_date"), F.count(F.lit(1)).alias("bars"))
    joined = symbols.join(found, "ticker", "left")
    return joined.select("ticker", "provider_symbol", "first_date", "last_date", F.coalesce("bars", F.lit(0)).alias("bars"), F.when(F.col("bars").isNull(), "no data").alias("error"))
