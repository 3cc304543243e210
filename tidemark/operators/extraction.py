"""Checks of structured extractions against their source text, and cost tracking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.sizes import small


def grounded(quote: Column, text: Column, start: Column, end: Column) -> Column:
    """Whether the half-open span of the text is the quote."""
    return F.coalesce((end > start) & (F.substring(text, start + 1, end - start) == quote), F.lit(False))


def locate(quote: Column, text: Column) -> Column:
    """status (resolved, absent, ambiguous; overlapping matches count), start and end of a quote in a text."""
    first = F.position(quote, text)
    second = F.position(quote, F.substring(text, first + 1, F.length(text)))
    status = F.when(first == 0, "absent").when(second > 0, "ambiguous").otherwise("resolved")
    return F.struct(status.alias("status"), F.when(status == "resolved", first - 1).alias("start"), F.when(status == "resolved", first - 1 + F.length(quote)).alias("end"))


def number_faults(value_text: Column, value: Column, quote: Column, unit: Column, scale: Column, period: Column) -> Column:
    """Names of the numeric-fidelity rules that an extracted number breaks."""
    lexical = F.regexp_replace(value_text, ",", "").try_cast("decimal(38,18)")
    escaped = F.concat(F.lit(r"(?<![\w.,+\-])\Q"), value_text, F.lit(r"\E(?![\w.,])"))
    rules = [
        (lexical.isNull(), "number_lexeme_unparseable"),
        (lexical.isNotNull() & (lexical != value), "number_value_nonfinite_or_transformed"),
        (~F.rlike(quote, escaped), "number_absent_from_context"),
        (unit.isNotNull() & ~F.contains(quote, unit), "unit_absent_from_context"),
        (scale.isNotNull() & (scale != "one") & ~F.contains(quote, scale), "scale_absent_from_context"),
        (period.isNotNull() & ~F.contains(quote, period), "period_absent_from_context"),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for bad, name in rules]), lambda x: x.isNotNull())


#: Words that mark a quote as uncertain, negated or at a stage.
UNCERTAIN, NEGATED = r"\b(rumou?r|unconfirmed|may|might|expects?|expected|opinion)\b", r"\b(not|never|no|denied|denies)\b"


def event_faults(state: Column, stage: Column, quote: Column, negated: Column) -> Column:
    """Lexical checks of an event's state, stage and negation against its quote."""
    q = F.lower(quote)
    rules = [
        ((state == "confirmed") & q.rlike(UNCERTAIN), "rumor_promoted"),
        ((stage == "completed") & ~q.rlike(r"\b(completed|closed|finalized)\b"), "completion_literal_missing"),
        ((stage == "announced") & ~q.rlike(r"\bannounced\b"), "announced_literal_missing"),
        ((stage == "proposed") & ~q.rlike(r"\bproposed\b"), "proposed_literal_missing"),
        (q.rlike(NEGATED) & ~negated, "negation_token_present_flag_false"),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for bad, name in rules]), lambda x: x.isNotNull())


def directive(text: Column) -> Column:
    """Whether a narrative gives investment orders or predictions."""
    return text.rlike(r"\b(BUY|SELL|HOLD)\b|(?i:price target|expected return|portfolio weight)")


def token_cost(input_tokens: Column, output_tokens: Column, input_price: Column, output_price: Column) -> Column:
    """Cost by prices for a million tokens."""
    return (input_tokens * input_price + output_tokens * output_price) / 1_000_000


def costs(ledger: DataFrame, by: list[str]) -> DataFrame:
    """Known cost and unknown calls for every subset of the dimensions."""
    return ledger.cube(*by).agg(F.sum("cost").alias("cost"), F.count_if(F.col("cost").isNull()).alias("unknown"), F.grouping_id().alias("level"))


def reserved(ledger: DataFrame) -> DataFrame:
    """Budget in use: settled amounts, else reservations."""
    return ledger.agg(F.sum(F.coalesce("settled", "reserved")).alias("in_use"))


def alive(df: DataFrame, now: Column) -> DataFrame:
    """Sidecar records within their life, start included and end not."""
    return df.where((F.col("created_at") <= now) & (now < F.col("expires_at")))


def routed(tasks: DataFrame, routes: DataFrame) -> DataFrame:
    """Model of each (agent, task): the task's own route, else agent.task, else the default."""
    route = small(routes)
    a = route.select(F.col("route").alias("r1"), F.col("model").alias("m1"))
    b = route.select(F.col("route").alias("r2"), F.col("model").alias("m2"))
    c = route.where("route = 'default'").select(F.col("model").alias("m3"))
    out = tasks.join(a, F.col("task") == F.col("r1"), "left").join(b, F.concat_ws(".", "agent", "task") == F.col("r2"), "left").crossJoin(F.broadcast(c))
    return out.select("agent", "task", F.coalesce("m1", "m2", "m3").alias("model"))


def contradictory_amounts(amounts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, values): amounts (keys, role, unit, value) for which one event states several values of a role and unit."""
    several = amounts.groupBy(*keys, "role", "unit").agg(F.count_distinct("value").alias("values")).where("values > 1")
    return several.select(*keys, "role", "unit", "values")


def unbacked_entities(mentions: DataFrame, registry: DataFrame) -> DataFrame:
    """Mentions (entity_id, day) that no registry row of that day backs."""
    rows = small(registry.select("entity_id", "effective_from", "effective_to"))
    holds = (mentions["entity_id"] == rows["entity_id"]) & (F.col("effective_from") <= mentions["day"]) & (F.col("effective_to").isNull() | (mentions["day"] < F.col("effective_to")))
    return mentions.join(rows, holds, "left_anti")


def requests(current: DataFrame, registry: DataFrame, cutoff: Column) -> DataFrame:
    """Interpretation requests: current revisions with the registry rows that hold on their fact date and were known by cutoff.

    current comes from query_as_of, so future and replaced revisions can't be asked for. The registry
    is a small dimension, joined by ticker.
    """
    facts = current.withColumn("fact_date", F.to_date(F.coalesce("published_at", "available_at"))).withColumn("ticker", F.explode_outer("direct_tickers"))
    rows = small(registry.where(F.col("known_at") <= cutoff))
    holds = (facts["ticker"] == rows["ticker"]) & (F.col("effective_from") <= facts["fact_date"]) & (F.col("effective_to").isNull() | (facts["fact_date"] < F.col("effective_to")))
    joined = facts.join(rows.select("ticker", "effective_from", "effective_to", "security_id"), holds, "left")
    return joined.groupBy("revision_id").agg(F.min("fact_date").alias("fact_date"), F.array_sort(F.collect_set("security_id")).alias("securities"))


def cached(requests_: DataFrame, cache: DataFrame, content: list[str]) -> DataFrame:
    """requests_ with the response that the cache holds for their content's hash (content_hash), or null."""
    key = F.sha2(F.concat_ws("\u0000", *content), 256)
    return requests_.withColumn("content_hash", key).join(cache.select("content_hash", "response"), "content_hash", "left")


def reservation_bound(prompt_bytes: Column, max_output_tokens: Column, input_price: Column, output_price: Column) -> Column:
    """Most that a call may cost: a token a byte in, and all output tokens, at prices for a million tokens."""
    return token_cost(prompt_bytes, max_output_tokens, input_price, output_price)


def replay_faults(stored: DataFrame, replayed: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, fault): envelopes that a replay lacks, adds, or whose fingerprint of columns differs."""
    print_of = F.sha2(F.to_json(F.struct(*sorted(columns))), 256)
    a = stored.select(key, print_of.alias("_a"))
    b = replayed.select(key, print_of.alias("_b"))
    fault = F.when(F.col("_a").isNull(), "not_stored").when(F.col("_b").isNull(), "not_replayed").when(F.col("_a") != F.col("_b"), "fingerprint_mismatch")
    return a.join(b, key, "full").select(key, fault.alias("fault")).where("fault is not null")
