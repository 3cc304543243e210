"""Parquet tables: filtered scans, keyed upserts, authoritative range rebuilds, integrity checks, provider records."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.sizes import small

_COMPARE = {"==": lambda c, v: c == v, "=": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "in": lambda c, v: c.isin(*v)}
BAR_KEY = ["ticker", "trading_date", "provider"]


def query(spark: SparkSession, sql: str, args: list | None = None) -> DataFrame:
    """SQL with positional parameters."""
    return spark.sql(sql, args=args or [])


def scan(spark: SparkSession, path: str, filters: list[tuple] | None = None, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table with conjunctive (column, operator, value) filters, which reach the reader."""
    df = spark.read.parquet(path)
    for name, operator, value in filters or []:
        df = df.where(_COMPARE[operator](F.col(name), value))
    return df.select(*columns) if columns else df


def save(df: DataFrame, path: str, partitions: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], newest: str = "ingested_at") -> DataFrame:
    """Union that keeps each key's last row by newest; equal times go to the incoming row."""
    both = existing.withColumn("_in", F.lit(0)).unionByName(incoming.withColumn("_in", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, keys, [F.desc(newest), F.desc("_in")]).drop("_in")


def replace_dates(existing: DataFrame, incoming: DataFrame, refreshed: DataFrame, keys: list[str], day: str = "effective_date") -> DataFrame:
    """Rows on refreshed (ticker, day) are replaced by the incoming ones, one for each key."""
    kept = existing.join(refreshed.select("ticker", day).distinct(), ["ticker", day], "left_anti")
    return upsert(kept, incoming, keys)


def replace_range(existing: DataFrame, incoming: DataFrame, tickers: list[str], start: date, end: date, day: str = "decision_date") -> DataFrame:
    """An authoritative rebuild: rows of the tickers in the range go, also where nothing comes in for them."""
    stale = F.col("ticker").isin(*tickers) & F.col(day).between(F.lit(start), F.lit(end))
    return existing.where(~F.coalesce(stale, F.lit(False))).unionByName(incoming)


def swap(df: DataFrame, path: str, fresh: str) -> DataFrame:
    """Write beside a table that df reads and give the new one; the caller drops the old."""
    if path.rstrip("/") == fresh.rstrip("/"):
        raise ValueError("a table can't be overwritten while it is read")
    save(df, fresh)
    return df.sparkSession.read.parquet(fresh)


def feature_range(df: DataFrame, start: date, end: date, columns: list[str], tickers: list[str] | None = None) -> DataFrame:
    """Allow-listed columns of an inclusive range; a table by year is pruned, and labels are refused."""
    leaked = [c for c in columns if c.startswith("target_")]
    if leaked:
        raise ValueError(f"labels can't be read as features: {leaked}")
    unknown = sorted(set(columns) - set(df.columns))
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")
    if "year" in df.columns:
        df = df.where(F.col("year").between(start.year, end.year))
    df = df.where(F.col("decision_date").between(F.lit(start), F.lit(end)))
    if tickers:
        df = df.where(F.col("ticker").isin(*tickers))
    return df.select("ticker", "decision_date", *dict.fromkeys(c for c in columns if c not in ("ticker", "decision_date")))


def earliest_records(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Idempotent write of revisions: of equal (revision, versions) the one seen first stays."""
    both = existing.unionByName(incoming)
    return keep_last(both, ["revision_id", "schema_version", "normalizer_version"], [F.asc("first_seen_at"), F.asc("ingested_at"), F.asc("raw_hash")])


def migrated(records: DataFrame) -> DataFrame:
    """Legacy proxy availability moves to historical_proxy_at; availability is when it was first seen."""
    proxy = F.col("availability_basis") == "published_at_proxy"
    return records.withColumns({"historical_proxy_at": F.when(proxy, F.col("available_at")).otherwise(F.col("historical_proxy_at")), "available_at": F.when(proxy, F.col("first_seen_at")).otherwise(F.col("available_at"))})


def raw_captures(payloads: DataFrame, existing: DataFrame) -> DataFrame:
    """New captures, keyed by the payload's sha256."""
    keyed = payloads.withColumn("payload_hash", F.sha2(F.col("payload").cast("binary"), 256))
    return keep_last(keyed, ["payload_hash"], [F.asc("captured_at")]).join(existing.select("payload_hash"), "payload_hash", "left_anti")


def integrity(records: DataFrame, captures: DataFrame) -> DataFrame:
    """One row of counters: records, articles, revisions, duplicates and records without a capture."""
    missing = records.join(captures.select(F.col("payload_hash").alias("raw_hash")).distinct(), "raw_hash", "left_anti").agg(F.count(F.lit(1)).alias("without_capture"))
    counts = records.agg(F.count(F.lit(1)).alias("records"), F.count_distinct("news_id").alias("articles"), F.count_distinct("revision_id").alias("revisions"))
    return counts.withColumn("duplicates", F.col("records") - F.col("revisions")).crossJoin(F.broadcast(missing))


def internal_symbols(df: DataFrame, aliases: DataFrame, column: str = "ticker") -> DataFrame:
    """Provider symbols by a small alias table; others stay as they are."""
    return df.join(small(aliases), column, "left").withColumn("provider_symbol", F.coalesce("provider_symbol", F.col(column)))


BAR_JSON = "date string, open double, high double, low double, close double, volume double, adjClose double, splitFactor double, divCash double"


def parse_bars(lines: DataFrame, ticker: str | Column) -> DataFrame:
    """Provider JSON (column value) of a ticker, or of a column of tickers, to bars; they are available at 20:00 market time of their day."""
    named = F.lit(ticker) if isinstance(ticker, str) else ticker
    day = F.to_date(F.substring("r.date", 1, 10))
    return lines.select(named.alias("_ticker"), F.from_json("value", BAR_JSON).alias("r")).where("r.close is not null").select(
        F.col("_ticker").alias("ticker"), day.alias("trading_date"), "r.open", "r.high", "r.low", "r.close", "r.volume",
        F.col("r.adjClose").alias("adjusted_close"),
        F.when(F.coalesce("r.splitFactor", F.lit(0.0)) == 0, 1.0).otherwise(F.col("r.splitFactor")).alias("split_factor"),
        F.coalesce("r.divCash", F.lit(0.0)).alias("dividend_cash"),
        F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", day.cast("string"), F.lit("20:00:00"))), "America/New_York").alias("available_at"),
    )


NEWS_JSON = "id bigint, headline string, summary string, url string, datetime bigint, related string"


def parse_news(lines: DataFrame, provider: str, captured_at: Column, live: bool = True) -> DataFrame:
    """Provider JSON to revisions with content ids; live items are available when published and captured, others when captured."""
    r = lines.select(F.from_json("value", NEWS_JSON).alias("r")).where("r.id is not null").select("r.*").withColumn("published_at", F.timestamp_seconds("datetime"))
    news_id = F.sha2(F.concat_ws("\u0000", F.lit("news"), F.lit(provider), F.col("id").cast("string")), 256)
    content = F.sha2(F.concat_ws("\u0000", F.coalesce("headline", F.lit("")), F.coalesce("summary", F.lit("")), F.coalesce("url", F.lit(""))), 256)
    tickers = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.coalesce("related", F.lit("")), ","), lambda t: F.upper(F.trim(t))), lambda t: t != "")))
    available = F.greatest("published_at", captured_at) if live else captured_at
    out = r.select(F.lit(provider).alias("provider"), news_id.alias("news_id"), content.alias("content_hash"), "headline", "summary", "url", "published_at", available.alias("available_at"), captured_at.alias("first_seen_at"), tickers.alias("direct_tickers"))
    return out.withColumn("revision_id", F.sha2(F.concat_ws("\u0000", F.lit("revision"), "news_id", "content_hash"), 256))


def append_audit(df: DataFrame, path: str) -> None:
    """Append-only JSON lines."""
    df.write.mode("append").json(path)
