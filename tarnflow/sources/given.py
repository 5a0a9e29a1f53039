"""The roles of a recommender's tables, taken from the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """(user, item, ts, kind) of each event."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("user"), F.get_json_object("props", "$.k").cast("long").alias("item"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind")
    )


def purchases(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).where("kind = 'purchase'").drop("kind")


def visits(spark: SparkSession, folder: str) -> DataFrame:
    return events(spark, folder).where("kind in ('view', 'click')").drop("kind")


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    """(user, item, rating, ts) of each order line: the large log."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"), (F.col("l_quantity") % 5 + 1).cast("double").alias("rating"), F.col("o_orderdate").cast("timestamp").alias("ts")
    )


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct (user, item) of the large log."""
    return ratings(spark, folder).select("user", "item").distinct()


def items(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("item"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").cast("long").alias("size"), F.col("p_retailprice").alias("price")
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user"), F.col("c_nationkey").cast("long").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
