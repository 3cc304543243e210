"""Filters, joins, set operations and scalar expressions of the inventory, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.operators import allocation, targets
from tidemark.plans import base


def f05_candidate_days(spark, sf_dir):
    """Distinct event days that are sessions, by a semi join (J13)."""
    days = base.bars(spark, sf_dir).select(F.col("trading_date").alias("session")).distinct()
    return days.join(base.calendar(spark, sf_dir), "session", "left_semi").where("session between date '1996-01-01' and date '1997-12-31'")


def f09_nullable_flags(spark, sf_dir):
    rows = base.read(spark, sf_dir, "documents").select("doc_id").join(base.read(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.withColumn("flag", F.col("toxic") == 1).groupBy(targets.eligible("flag").alias("flag")).agg(F.count(F.lit(1)).alias("rows"))


def f11_finite(spark, sf_dir):
    w = Window.partitionBy("ticker").orderBy("trading_date")
    rows = base.bars(spark, sf_dir).withColumn("momentum", F.try_divide(F.col("volume"), F.lag("volume", 3).over(w)) - 1)
    return rows.where(allocation.finite("momentum")).groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"))


def f12_infinite_to_null(spark, sf_dir):
    rows = base.read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("value")).alias("v"))
    return rows.agg(F.count(F.when(F.abs("v") < float("inf"), F.col("v"))).alias("finite"), F.count(F.lit(1)).alias("rows"))


def j02_left_complete(spark, sf_dir):
    """Orders with their line count, missing ones as 0, and how many have none."""
    lines = base.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    joined = base.read(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    return joined.agg(F.count(F.lit(1)).alias("orders"), F.sum(F.coalesce("n", F.lit(0))).alias("lines"), F.count_if(F.col("n").isNull()).alias("without"))


def j12_anti(spark, sf_dir):
    orders, customers = base.read(spark, sf_dir, "orders").where("o_custkey % 7 > 0"), base.read(spark, sf_dir, "customer")
    return customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


def j16_key_difference(spark, sf_dir):
    """Keys that one of two prediction sets lacks."""
    a = base.read(spark, sf_dir, "labels").select("doc_id")
    b = base.read(spark, sf_dir, "documents").where("n_chars > 500").select("doc_id")
    return a.exceptAll(b).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("only_left")).unionByName(b.exceptAll(a).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("only_right")))


def a01_same_day_product(spark, sf_dir):
    rows = base.actions(spark, sf_dir).where("action_type = 'split'")
    return rows.groupBy("ticker").agg(F.product("split_factor").alias("factor"), F.count(F.lit(1)).alias("splits"))


def a15_exposure(spark, sf_dir):
    w = allocation.momentum_top(base.bars(spark, sf_dir).select("ticker", F.col("trading_date").alias("decision_date"), F.col("volume").alias("momentum_20d"), F.lit(True).alias("model_eligible")), 4, 0.2)
    daily = w.groupBy("decision_date").agg(F.count(F.lit(1)).alias("n"))
    return daily.agg(F.round(F.avg(F.col("n") * 0.2), 6).alias("average_exposure"), F.min("n").alias("fewest"), F.max("n").alias("most"))


def a17_cash_by_type(spark, sf_dir):
    return base.actions(spark, sf_dir).groupBy("action_type").agg(F.sum(F.coalesce("dividend_cash", F.lit(0.0))).alias("cash"), F.count("dividend_cash").alias("payments"))


def a24_family_means(spark, sf_dir):
    """Mean of group means, so that large groups don't weigh more."""
    rows = base.read(spark, sf_dir, "labels").join(base.read(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    return rows.groupBy("lang", "source").agg(F.avg("quality").alias("m")).groupBy("lang").agg(F.round(F.avg("m"), 6).alias("mean"))


def t05_examples(spark, sf_dir):
    rows = base.read(spark, sf_dir, "lineitem").where("l_discount > 0.05").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return rows.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").limit(100)


def x05_liquidity_log(spark, sf_dir):
    return base.read(spark, sf_dir, "part").select("p_partkey", F.round(F.log1p("p_retailprice"), 6).alias("logged"), F.least(F.greatest("p_size", F.lit(10)), F.lit(40)).alias("clipped"))


def x06_sets(spark, sf_dir):
    docs = base.read(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("types"))
    return docs.select("user_id", F.size(F.array_intersect("types", F.array(F.lit("click"), F.lit("view")))).alias("common"), F.concat_ws("|", "types").alias("types"))


def x07_json(spark, sf_dir):
    """Canonical hashes of JSON values; key order doesn't matter."""
    return base.read(spark, sf_dir, "events").select("event_id", C.canonical_hash(F.col("props")).alias("hash"))


def x09_classes(spark, sf_dir):
    kind = F.when(F.col("value") >= 75, "high").when(F.col("value") >= 25, "middle").otherwise("low")
    return base.read(spark, sf_dir, "events").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("events"))


def x10_redaction(spark, sf_dir):
    rows = base.read(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("url?token=abc"), F.col("n_nationkey"), F.lit(" for "), F.col("n_name")).alias("message"))
    return rows.select("n_nationkey", C.redacted(F.col("message")).alias("message"))


QUERIES = {
    "f05_candidate_days": f05_candidate_days,
    "f09_nullable_flags": f09_nullable_flags,
    "f11_finite": f11_finite,
    "f12_infinite_to_null": f12_infinite_to_null,
    "j02_left_complete": j02_left_complete,
    "j12_anti": j12_anti,
    "j16_key_difference": j16_key_difference,
    "a01_same_day_product": a01_same_day_product,
    "a15_exposure": a15_exposure,
    "a17_cash_by_type": a17_cash_by_type,
    "a24_family_means": a24_family_means,
    "t05_examples": t05_examples,
    "x05_liquidity_log": x05_liquidity_log,
    "x06_sets": x06_sets,
    "x07_json": x07_json,
    "x09_classes": x09_classes,
    "x10_redaction": x10_redaction,
}

ORACLES = {
    "f05_candidate_days": base.sql("select distinct trading_date as session from bars where trading_date between date '1996-01-01' and date '1997-12-31'"),
    "f09_nullable_flags": "select coalesce(toxic = 1, false) as flag, count(*) as rows from documents left join labels using (doc_id) group by 1",
    "f11_finite": base.sql("select ticker, greatest(count(*) - 3, 0) as rows from bars group by 1 having count(*) > 3"),
    "f12_infinite_to_null": "select count(case when event_id % 7 <> 0 then value end) as finite, count(*) as rows from events",
    "j02_left_complete": "select count(*) as orders, cast(sum(coalesce(n, 0)) as bigint) as lines, count(case when n is null then 1 end) as without from orders left join (select l_orderkey as o_orderkey, count(*) as n from lineitem group by 1) using (o_orderkey)",
    "j12_anti": "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_custkey % 7 > 0)",
    "j16_key_difference": "select (select count(*) from (select doc_id from labels except all select doc_id from documents where n_chars > 500)) as n, 'only_left' as side union all select (select count(*) from (select doc_id from documents where n_chars > 500 except all select doc_id from labels)), 'only_right'",
    "a01_same_day_product": base.sql("select ticker, product(split_factor) as factor, count(*) as splits from actions where action_type = 'split' group by 1"),
    "a15_exposure": base.sql("select round(avg(n * 0.2), 6) as average_exposure, min(n) as fewest, max(n) as most from (select trading_date, least(count(*), 4) as n from bars group by 1)"),
    "a17_cash_by_type": base.sql("select action_type, cast(sum(coalesce(dividend_cash, 0)) as double) as cash, count(dividend_cash) as payments from actions group by 1"),
    "a24_family_means": "select lang, round(avg(m), 6) as mean from (select lang, source, avg(quality) as m from labels join documents using (doc_id) group by 1, 2) group by 1",
    "t05_examples": "select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem where l_discount > 0.05 order by 1, 2, 3, 4 limit 100",
    "x05_liquidity_log": "select p_partkey, round(ln(1 + p_retailprice), 6) as logged, least(greatest(p_size, 10), 40) as clipped from part",
    "x06_sets": "select user_id, count(distinct case when event_type in ('click', 'view') then event_type end) as common, string_agg(distinct event_type, '|' order by event_type) as types from events group by 1",
    "x09_classes": "select case when value >= 75 then 'high' when value >= 25 then 'middle' else 'low' end as kind, count(*) as events from events group by 1",
    "x10_redaction": "select n_nationkey, 'url?token=*** for ' || n_name as message from nation",
}
