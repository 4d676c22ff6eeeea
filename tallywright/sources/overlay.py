"""Canonical facts and dimensions over the TPC-H-like tables; DataFrames only, nothing is evaluated here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRANSACTION_KEY = ("organization_id", "location_id", "occurred_at", "source_key", "source_record_id")
STOCK_KEY = ("organization_id", "location_id", "variant_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(c: str) -> Column:
    return F.col(c).cast("string")


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as delivered: some twice, some corrected an hour later."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    base = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        text("n_regionkey").alias("organization_id"),
        text("n_nationkey").alias("location_id"),
        F.col("c_mktsegment").alias("channel_id"),
        text("o_orderkey").alias("transaction_id"),
        F.lit("orders").alias("source_key"),
        text("o_orderkey").alias("source_record_id"),
        F.round(F.col("o_totalprice").cast("decimal(18,2)") * 100, 0).cast("long").alias("amount_minor"),
        F.lit("GBP").alias("currency"),
        F.col("o_orderdate").alias("occurred_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("ingested_at"),
        F.lit(1).alias("mapping_version"),
        F.concat(F.lit("orders/"), text("o_orderkey")).alias("lineage_ref"),
    )
    # one scan and join: the versions of an order are rows made of its own
    k = F.col("source_record_id").cast("long")
    as_is = F.struct(F.col("amount_minor"), F.col("ingested_at"), F.col("mapping_version"))
    corrected = F.struct((F.col("amount_minor") + 250).alias("amount_minor"), (F.col("ingested_at") + F.expr("INTERVAL 1 HOUR")).alias("ingested_at"), F.lit(2).alias("mapping_version"))
    versions = F.filter(F.array(as_is, F.when(k % 11 == 0, as_is), F.when(k % 7 == 0, corrected)), lambda v: v.isNotNull())
    changing = ("amount_minor", "ingested_at", "mapping_version")
    each = base.withColumn("_version", F.explode(versions))
    return each.select(*[F.col(f"_version.{c}").alias(c) if c in changing else F.col(c) for c in base.columns])


def stock_events(spark: SparkSession, sf_dir: str, event_type: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type") == event_type)
        .select(
            (F.col("user_id") % 5).cast("string").alias("organization_id"),
            (F.col("user_id") % 25).cast("string").alias("location_id"),
            text("user_id").alias("variant_id"),
            "event_id",
            F.col("ts").alias("occurred_at"),
            F.col("value").cast("decimal(18,4)").alias("quantity"),
        )
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stock_events(spark, sf_dir, "view")


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stock_events(spark, sf_dir, "purchase")


def quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .where("event_type = 'error'")
        .select((F.col("user_id") % 5).cast("string").alias("organization_id"), F.concat(F.lit("feed-"), (F.col("user_id") % 4).cast("string")).alias("source_key"), text("event_id").alias("source_record_id"), F.array(F.lit("out_of_range")).alias("reason_flags"), F.col("ts").alias("occurred_at"))
    )


def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .where("event_type in ('view', 'purchase')")
        .select((F.col("user_id") % 5).cast("string").alias("organization_id"), F.concat(F.lit("feed-"), (F.col("user_id") % 4).cast("string")).alias("source_key"), text("event_id").alias("source_record_id"), F.col("ts").alias("occurred_at"))
    )
