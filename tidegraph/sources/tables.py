"""Tables of the domain as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The canonical review log.
REVIEW_SCHEMA = T.StructType(
    [
        T.StructField("review_id", T.StringType(), False),
        T.StructField("reviewer_id", T.StringType()),
        T.StructField("target_id", T.StringType()),
        T.StructField("variant_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("source", T.StringType(), False),
        T.StructField("source_row", T.LongType(), False),
        T.StructField("source_file_hash", T.StringType(), False),
        T.StructField("verified_purchase", T.BooleanType()),
        T.StructField("text_missing", T.BooleanType()),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str | Column) -> Column:
    """Epoch microseconds of a timestamp, with or without a zone."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def event_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a review log: one row per event, the JSON key k as target."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("review_id"),
        F.col("user_id").alias("reviewer_id"),
        F.get_json_object("props", "$.k").cast("long").alias("target_id"),
        micros("ts").alias("us"),
        (F.lit(1) + F.col("event_id") % 5).cast("double").alias("rating"),
        F.col("event_type"),
        F.col("value"),
    )


def order_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a review log with many ties: whole-day times, the least part of an order as target."""
    first = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("target_id"))
    o = table(spark, sf_dir, "orders")
    return o.join(first, o.o_orderkey == first.l_orderkey).select(
        F.col("o_orderkey").alias("review_id"),
        F.col("o_custkey").alias("reviewer_id"),
        "target_id",
        micros("o_orderdate").alias("us"),
        (F.lit(1) + F.col("o_orderkey") % 5).cast("double").alias("rating"),
    )


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a score in [0, 1) from their value and a label from their type (signup: unknown)."""
    e = event_reviews(spark, sf_dir)
    return e.select(
        "review_id",
        "reviewer_id",
        "target_id",
        "us",
        (F.pmod(F.floor(F.col("value") * 100).cast("long"), F.lit(1000)) / 1000.0).alias("score"),
        F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "signup", None).otherwise(0).alias("label"),
    )
