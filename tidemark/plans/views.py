"""The research tables that the star schema and event tables stand for, once for Spark and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.study import monthly_aggregate
from tidemark.tables import load


def segment_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, date, price): the mean order price of a market segment's day."""
    customer = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("symbol"))
    return _panel(load(spark, sf_dir, "orders"), customer)


def nation_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, date, price): the same by nation, twenty-five symbols."""
    symbol = F.concat(F.lit("N"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"))
    return _panel(load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer").select("c_custkey", symbol.alias("symbol")))


def _panel(orders: DataFrame, customer: DataFrame) -> DataFrame:
    rows = orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
    return rows.groupBy("symbol", F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("price"))


def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monthly_aggregate(nation_panel(spark, sf_dir))


PANEL_SQL = "panel as (select c_mktsegment symbol, cast(o_orderdate as date) date, avg(o_totalprice) price from orders join customer on o_custkey = c_custkey group by all)"
NATION_SQL = "panel as (select 'N' || lpad(cast(c_nationkey as varchar), 2, '0') symbol, cast(o_orderdate as date) date, avg(o_totalprice) price from orders join customer on o_custkey = c_custkey group by all)"
DAILY_SQL = "daily as (select *, price / lag(price) over (partition by symbol order by date) - 1 daily_return from panel)"
MONTHLY_SQL = f"""{NATION_SQL}, {DAILY_SQL},
  monthly as (select symbol, strftime(date, '%Y-%m') as "month", min(date) first_date, arg_min(price, date) first_price, arg_max(price, date) "close", coalesce(max(daily_return), 0.0) daily_max from daily group by all)"""
