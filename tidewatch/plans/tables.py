"""Stand-ins of the domain's tables in the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as payments: props.k is both payee and device."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    return e.select(F.col("event_id").alias("tx_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("user_id").alias("cust"), F.col("value").alias("amount"), F.col("event_type").alias("channel"), k.alias("payee"), k.alias("device"))


EVENT_TX = """t AS (
  SELECT event_id AS tx_id, epoch_us(ts) AS us, user_id AS cust, value AS amount, event_type AS channel,
         json_extract_string(props, '$.k') AS payee, json_extract_string(props, '$.k') AS device
  FROM events)"""


def order_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as payments: the payee is the least supplier of the lines, the device the least part."""
    o = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"))
    j = o.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return j.select(F.col("o_orderkey").alias("tx_id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"), F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("channel"), text("s").alias("payee"), text("p").alias("device"), F.col("o_orderstatus").alias("status"))


ORDER_TX = """t AS (
  SELECT o_orderkey AS tx_id, epoch_us(o_orderdate) AS us, o_custkey AS cust, o_totalprice AS amount, o_orderpriority AS channel,
         coalesce(s::VARCHAR, '') AS payee, coalesce(p::VARCHAR, '') AS device, o_orderstatus AS status
  FROM orders LEFT JOIN (SELECT l_orderkey, min(l_suppkey) AS s, min(l_partkey) AS p FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""
