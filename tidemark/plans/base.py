"""Relations that the registered queries share, derived from the driver's tables, in DataFrame and SQL form.

bars: one row for each nation (ticker) and ship date; market: the same over all nations (benchmark);
actions: split and dividend actions by nation and month; calendar: sessions in order.
Money is summed as decimals so that both engines get the same doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount")
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return items.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))


def _bar(trades: DataFrame, *keys) -> DataFrame:
    price, quantity = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_quantity").cast("decimal(18,2)")
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    first = F.col("l_linenumber") == 1
    vwap = F.sum(price).cast("double") / F.sum(quantity).cast("double")
    opening = F.sum(F.when(first, price)).cast("double") / F.sum(F.when(first, quantity)).cast("double")
    return trades.groupBy(*keys).agg(
        F.coalesce(opening, vwap).alias("open"),
        F.max(unit).alias("high"),
        F.min(unit).alias("low"),
        vwap.alias("close"),
        F.sum(quantity).cast("double").alias("volume"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, trading_date, open, high, low, close, volume, available_at)"""
    out = _bar(_trades(spark, sf_dir), F.col("n_name").alias("ticker"), F.to_date("l_shipdate").alias("trading_date"))
    return out.withColumn("available_at", F.to_utc_timestamp(F.expr("timestamp(trading_date) + interval 20 hours"), "America/New_York"))


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bar(_trades(spark, sf_dir), F.to_date("l_shipdate").alias("trading_date"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, effective_date, action_type, split_factor, dividend_cash, available_at)"""
    orders = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    months = joined.groupBy(F.col("n_name").alias("ticker"), F.expr("date_add(to_date(trunc(o_orderdate, 'MM')), 14)").alias("effective_date")).agg(F.min("o_orderkey").alias("k"))
    split = F.pmod("k", F.lit(4)) < 2
    return months.where("pmod(k, 5) < 2").select(
        "ticker",
        "effective_date",
        F.when(split, "split").otherwise("cash_dividend").alias("action_type"),
        F.when(split, F.when(F.pmod("k", F.lit(2)) == 0, 2.0).otherwise(0.5)).alias("split_factor"),
        F.when(~split, (F.pmod("k", F.lit(7)) + 1) * 0.25).cast("double").alias("dividend_cash"),
        F.expr("timestamp(date_add(effective_date, cast(pmod(k, 3) as int)))").alias("available_at"),
    )


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, seq): sessions numbered from 0."""
    days = read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("session")).distinct()
    return days.withColumn("seq", F.row_number().over(Window.orderBy("session")) - 1)


#: DuckDB forms of the same relations.
CTE = """
trades as (
  select l.*, n_name from lineitem l join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey),
bars as (
  select n_name as ticker, cast(l_shipdate as date) as trading_date,
    coalesce(cast(sum(case when l_linenumber = 1 then cast(l_extendedprice as decimal(18,2)) end) as double) / cast(sum(case when l_linenumber = 1 then cast(l_quantity as decimal(18,2)) end) as double),
             cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / cast(sum(cast(l_quantity as decimal(18,2))) as double)) as open,
    max(l_extendedprice / l_quantity) as high, min(l_extendedprice / l_quantity) as low,
    cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / cast(sum(cast(l_quantity as decimal(18,2))) as double) as close,
    cast(sum(cast(l_quantity as decimal(18,2))) as double) as volume
  from trades group by 1, 2),
market as (
  select cast(l_shipdate as date) as trading_date,
    cast(sum(cast(l_extendedprice as decimal(18,2))) as double) / cast(sum(cast(l_quantity as decimal(18,2))) as double) as close
  from trades group by 1),
calendar as (
  select session, row_number() over (order by session) - 1 as seq
  from (select distinct cast(l_shipdate as date) as session from lineitem)),
action_months as (
  select n_name as ticker, cast(date_trunc('month', o_orderdate) as date) + 14 as effective_date, min(o_orderkey) as k
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
  where o_orderstatus = 'P' group by 1, 2),
actions as (
  select ticker, effective_date, case when k % 4 < 2 then 'split' else 'cash_dividend' end as action_type,
    case when k % 4 < 2 then case when k % 2 = 0 then 2.0 else 0.5 end end as split_factor,
    case when k % 4 >= 2 then (k % 7 + 1) * 0.25 end as dividend_cash,
    cast(effective_date + cast(k % 3 as integer) as timestamp) as available_at
  from action_months where k % 5 < 2)
"""


def sql(body: str, extra: str = "") -> str:
    """A DuckDB query over the derived relations."""
    return f"with {CTE}{', ' + extra if extra else ''} {body}"
