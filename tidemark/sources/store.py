"""Tables as versioned folders: atomic replacement, sidecars, yearly layouts, raw captures, snapshots."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources.tables import keep_last, save


def _files(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _files(spark, path)
    return files.exists(where)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written aside and renamed over the old one, so that readers see either whole."""
    jvm = spark._jvm
    fresh = f"{path}.{uuid.uuid4().hex}"
    files, where = _files(spark, fresh)
    out = files.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()
    renames = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    renames[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.makeQualified(where).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(files.makeQualified(where), files.makeQualified(_files(spark, path)[1]), renames)


def read_text(spark: SparkSession, path: str) -> str:
    files, where = _files(spark, path)
    stream = files.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_sidecar(spark: SparkSession, path: str, value: dict) -> None:
    """A manifest or report beside a table, as JSON with sorted keys."""
    write_text(spark, path, json.dumps(value, sort_keys=True, indent=1, default=str))


def read_sidecar(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, path))


def replace_table(df: DataFrame, root: str) -> None:
    """Replace the table at root in one step: a new folder is written, then the pointer to it is renamed."""
    version = f"v-{uuid.uuid4().hex}"
    save(df, f"{root}/{version}")
    write_text(df.sparkSession, f"{root}/_current", version)


def current_table(spark: SparkSession, root: str, schema: StructType | str) -> DataFrame:
    """The table at root as last replaced; empty where there is none."""
    if not exists(spark, f"{root}/_current"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/{read_text(spark, f'{root}/_current')}")


def ticker_rows(spark: SparkSession, root: str, ticker: str, schema: StructType | str) -> DataFrame:
    """One ticker of a table partitioned by ticker; an empty frame where nothing is stored."""
    if not exists(spark, root):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(root).where(F.col("ticker") == ticker)


def distinct_events(events: DataFrame, newest: list[Column]) -> DataFrame:
    """One row of each event_id, the first by newest."""
    return keep_last(events, ["event_id"], newest)


def upsert_years(incoming: DataFrame, root: str, keys: list[str], scratch: str, day: str = "decision_date") -> None:
    """Upsert into a table by year; only the years that incoming touches are rewritten.

    The merged years are written to scratch first, since a path can't be overwritten while it is read.
    """
    spark = incoming.sparkSession
    rows = incoming.withColumn("year", F.year(day))
    if exists(spark, root):
        years = [r.year for r in rows.select("year").distinct().collect()]  # a few
        stored = spark.read.schema(rows.schema).parquet(root).where(F.col("year").isin(years))
        both = stored.withColumn("_at", F.lit(0)).unionByName(rows.withColumn("_at", F.lit(1)))
        rows = keep_last(both, keys, [F.desc("_at")]).drop("_at")
    fresh = f"{scratch}/{uuid.uuid4().hex}"
    save(rows, fresh)
    merged = spark.read.schema(rows.schema).parquet(fresh)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(root)


def raw_items(captures: DataFrame, payloads: DataFrame, provider: str | None = None) -> DataFrame:
    """Captures (provider, capture_id, payload_hash) with their payload, in order of provider and capture."""
    chosen = captures if provider is None else captures.where(F.col("provider") == provider)
    return chosen.join(payloads.select("payload_hash", "payload"), "payload_hash").orderBy("provider", "capture_id")


def refuse_collisions(payloads: DataFrame) -> DataFrame:
    """payloads (payload_hash, payload), after a check that no hash stands for two payloads."""
    clash = payloads.groupBy("payload_hash").agg(F.min("payload").alias("a"), F.max("payload").alias("b")).where("a <> b")
    if not clash.isEmpty():
        raise ValueError("a raw payload hash stands for two payloads")
    return payloads


def replace_provider(existing: DataFrame, incoming: DataFrame, provider: str, schema_version: str, normalizer_version: str) -> DataFrame:
    """A rebuild: the provider's rows of these versions go, the incoming ones come; the earliest of a key stays."""
    stale = (F.col("provider") == provider) & (F.col("schema_version") == schema_version) & (F.col("normalizer_version") == normalizer_version)
    both = existing.where(~F.coalesce(stale, F.lit(False))).unionByName(incoming)
    return keep_last(both, ["revision_id", "schema_version", "normalizer_version"], [F.asc("first_seen_at"), F.asc("raw_hash")])


def lineage(records: DataFrame, captures: DataFrame, check: bool = True) -> DataFrame:
    """records with the captures whose payload has their hash; a record without one is an error."""
    keyed = captures.select(F.col("payload_hash").alias("raw_hash"), "capture_id")
    if check and not records.join(keyed, "raw_hash", "left_anti").isEmpty():
        raise ValueError("a revision has no raw capture")
    return records.join(keyed, "raw_hash")


def raw_integrity(records: DataFrame, captures: DataFrame, payloads: DataFrame) -> DataFrame:
    """One row of counters over captures (payload_hash), payloads (payload_hash, payload) and records."""
    broken = payloads.agg(F.count(F.lit(1)).alias("raw_payloads"), F.count_if(F.sha2(F.col("payload").cast("binary"), 256) != F.col("payload_hash")).alias("bad_raw_hashes"))
    missing = records.join(captures.select(F.col("payload_hash").alias("raw_hash")).distinct(), "raw_hash", "left_anti").agg(F.count(F.lit(1)).alias("missing_lineage"))
    counts = records.agg(F.count(F.lit(1)).alias("normalized_records"), F.count_distinct("news_id").alias("logical_articles"), (F.count(F.lit(1)) - F.count_distinct("revision_id", "schema_version", "normalizer_version")).alias("duplicate_records"))
    return captures.agg(F.count(F.lit(1)).alias("raw_captures")).crossJoin(F.broadcast(broken)).crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(missing))  # one row each


SNAPSHOT = ("inputs", "entity_links", "clusters", "pair_evidence")


def write_snapshot(tables: dict[str, DataFrame], root: str, manifest: dict) -> str:
    """Write a snapshot's tables as JSON rows under the hash of their content; the manifest goes last. Returns its id."""
    spark = next(iter(tables.values())).sparkSession
    rows = {name: tables[name].select(F.to_json(F.struct(*sorted(tables[name].columns))).alias("record_json")) for name in SNAPSHOT}
    parts = [rows[name].select(F.lit(name).alias("name"), F.sha2("record_json", 256).alias("h")) for name in SNAPSHOT]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # an order-free digest: sums of the rows' hashes by quarter, so nothing is collected but one row
    sums = every.groupBy("name").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in range(4)])
    snapshot_id = F.sha2(F.concat_ws("|", F.lit(json.dumps(manifest, sort_keys=True, default=str)), *[F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "name", "n", "s0", "s1", "s2", "s3"))), ",")]), 256)
    name = sums.agg(snapshot_id.alias("id")).first().id
    if not exists(spark, f"{root}/{name}/snapshot.json"):
        for table, df in rows.items():
            save(df, f"{root}/{name}/{table}")
        write_sidecar(spark, f"{root}/{name}/snapshot.json", manifest | {"snapshot_id": name})
    return name


def read_snapshot(spark: SparkSession, root: str, snapshot_id: str) -> dict[str, DataFrame]:
    """The record_json tables of a snapshot; one without its manifest is incomplete."""
    if read_sidecar(spark, f"{root}/{snapshot_id}/snapshot.json")["snapshot_id"] != snapshot_id:
        raise ValueError("a snapshot's manifest names another id")
    return {name: spark.read.schema("record_json string").parquet(f"{root}/{snapshot_id}/{name}") for name in SNAPSHOT}


def partition_faults(inputs: DataFrame, clusters: DataFrame, links: DataFrame) -> DataFrame:
    """One row: inputs, members, inputs in no cluster, inputs in several, members and links that are no input."""
    members = clusters.select(F.explode("members").alias("id"))
    times = members.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    state = inputs.select("id", F.lit(1).alias("known")).join(times, "id", "full").agg(
        F.count("known").alias("inputs"), F.coalesce(F.sum("n"), F.lit(0)).alias("members"),
        F.count_if(F.col("n").isNull()).alias("in_none"), F.count_if(F.col("known").isNotNull() & (F.col("n") > 1)).alias("in_several"), F.count_if(F.col("known").isNull()).alias("unknown_members"),
    )
    stray = links.join(inputs.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("unknown_links"))
    return state.crossJoin(F.broadcast(stray))  # one row each


def save_csv(df: DataFrame, path: str) -> None:
    """A summary as CSV with a header."""
    df.write.mode("overwrite").option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss").csv(path)


def audit_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What append_audit has written."""
    return spark.read.schema(schema).json(path)


def universe(spark: SparkSession, benchmark: str, tickers: list[str]) -> DataFrame:
    """(ticker, benchmark) of a configured universe; names are trimmed and upper-cased, and none may repeat."""
    names = [t.strip().upper() for t in tickers]
    if len(set(names)) < len(names) or not all(names) or benchmark.strip().upper() in names:
        raise ValueError("a universe's tickers must be named once, and not be its benchmark")
    return spark.createDataFrame([(t, False) for t in names] + [(benchmark.strip().upper(), True)], "ticker string, benchmark boolean")


def load_config(spark: SparkSession, path: str) -> dict:
    """A JSON file, or a YAML file where a YAML reader is installed."""
    text = read_text(spark, path)
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def settled(ledger: DataFrame, entries: DataFrame) -> DataFrame:
    """ledger (id, reserved, settled) after entries (id, amount) settle their reservations."""
    final = entries.groupBy("id").agg(F.max("amount").alias("_amount"))
    return ledger.join(final, "id", "left").withColumn("settled", F.coalesce("_amount", "settled")).drop("_amount")


